"""Population-scale analytics over labelled, located samples on PySpark."""

__version__ = "0.1.0"
