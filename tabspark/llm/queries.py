"""All queries of this subpackage and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "q_bm25",
    "q_decontaminate",
    "q_licenses",
    "q_merkle",
    "q_minhash",
    "q_packing",
    "q_pii",
    "q_prefix_trie",
    "q_quality",
    "q_rollup",
    "q_simhash",
    "q_toxicity",
    "q_warc",
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
