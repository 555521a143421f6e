"""Queries of this subpackage and their check SQL."""

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_MODULES = ("url_filter", "token_counts", "exact_dedup", "chat", "mixing", "language", "quality", "near_dedup", "decontamination", "token_output", "centroids", "prefix_trie", "secret_scan")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for name in _MODULES:
        import_module(f"volspark.llm.{name}")


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
