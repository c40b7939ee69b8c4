"""The queries of this package by name, and their SQL where SQL can state them."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, license_scan, secret_scan, simhash, substring_dedup, token_counts, token_planes, toxicity

MODULES = (token_counts, exact_dedup, substring_dedup, toxicity, simhash, token_planes, decontaminate, license_scan, bpe, secret_scan)


def queries() -> dict:
    return {m.QUERY: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE for m in MODULES if getattr(m, "ORACLE", None)}
