"""Every query of the package over the sample tables, with check SQL where SQL can express it."""

from importlib import import_module

from volspark.queries.registry import ORACLES, QUERIES

_MODULES = ("region_tables", "label_tables", "grid_ops", "agreement_ops", "cleanup_ops", "mesh_ops", "text_ops", "training_ops")


def _load():
    for name in _MODULES:
        import_module(f"volspark.queries.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
