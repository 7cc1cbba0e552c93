"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: Modules with a query each.
MODULES = ("embedding_dedup", "language_model", "licenses", "mixing", "ngram_join", "packing", "prefix_trie", "pseudonyms", "quality", "toxicity", "vector_codes", "warc", "winnowing")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"larkspur.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
