"""Queries of this subpackage by name; each module lists its own QUERIES and ORACLES."""

from __future__ import annotations

from importlib import import_module

MODULES = ("embeddings", "html", "linededup", "lm", "mixing", "packing", "quality", "secrets", "simhash", "urls")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"terraloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
