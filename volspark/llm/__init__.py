"""Operators that prepare text for training language models, with their queries."""

from volspark.llm.registry import load, oracles, queries

__all__ = ["load", "oracles", "queries"]
