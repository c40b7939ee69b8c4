"""Readers that turn text and bytes into streams."""
