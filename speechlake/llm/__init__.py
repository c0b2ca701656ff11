"""Operators for the preparation of training text.

Each module holds one operator and the query that applies it to its whole
table. ``load()`` imports them all and returns queries and SQL by name.
"""

from __future__ import annotations

import importlib

MODULES = ("quality", "simhash", "tokencounts", "decontamination", "pii", "pieces", "urls", "preferences", "scoring", "passages", "crosstokens", "filteraudit", "supportvectors")


def load() -> tuple[dict, dict]:
    """Queries and SQL counterparts of all operators, by name."""
    for name in MODULES:
        importlib.import_module(f"speechlake.llm.{name}")
    from speechlake.llm.common import QUERIES, SQL

    return QUERIES, SQL
