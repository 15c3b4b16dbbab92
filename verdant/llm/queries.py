"""Loads every module that registers queries of this subpackage."""

from __future__ import annotations

from verdant.llm import queries_corpus, queries_native, queries_statistics, queries_text  # noqa: F401
from verdant.llm.registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)
