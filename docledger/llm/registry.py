"""Queries of this package and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "chat", "lm_scoring", "language", "paragraph_dedup", "quality", "line_dedup", "sharding", "ngram_join", "decontamination", "block_max", "token_files", "phrases")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
