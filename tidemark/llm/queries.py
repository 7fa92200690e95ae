"""Queries of the corpus operators, by name, and the SQL that some of them equal."""

from __future__ import annotations

from tidemark.llm import bytespans, decontamination, importance, lexical, licenses, mixing, nearcopies, neargraph, pii, quality, sharding, substrings, toxicity

MODULES = [quality, sharding, mixing, pii, decontamination, substrings, nearcopies, toxicity, licenses, bytespans, importance, lexical, neargraph]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
