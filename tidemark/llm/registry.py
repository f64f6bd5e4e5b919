"""Queries of this subpackage over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> callable of spark and folder) and ORACLE_SQL (name -> DuckDB SQL).
MODULES = ("q_decontamination", "q_quality_classifier", "q_jaccard_join", "q_chat_formatting", "q_secret_scans", "q_lm_scoring", "q_fingerprints", "q_mixing", "q_token_counts", "q_language_id")


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), kind)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
