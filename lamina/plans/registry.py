"""Queries by name and, where SQL can express them, their oracles."""

from __future__ import annotations

from lamina.plans import alignments, assembly, catalogues, corpora, families, sequences

MODULES = (sequences, families, alignments, corpora, catalogues, assembly)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
