"""leafmesh: analytics over documents kept as tables of positioned text, on PySpark."""

__version__ = "0.1.0"
