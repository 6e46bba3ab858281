"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pii", "html_text", "sharding", "exact_dedup", "warc_zip", "langid", "decontaminate", "mixing", "lm_score", "ngram_join")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f".{name}", __name__).QUERIES
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f".{name}", __name__).ORACLE_SQL
    return found
