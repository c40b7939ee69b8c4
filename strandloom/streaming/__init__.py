"""Streams that arrive bit by bit: a chunk is a micro-batch's own, or carries its last value on."""
