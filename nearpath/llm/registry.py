"""Queries and SQL of all corpus operators."""

from __future__ import annotations

from nearpath.llm import bpe, exactdedup, langid, mixing, neardup, pii, quality, substring, tokenfile, toxicity

MODULES = (quality, langid, exactdedup, neardup, bpe, mixing, substring, toxicity, pii, tokenfile)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
