"""twinlens: utility and privacy evaluation of synthetic tables against their originals, on PySpark."""

__version__ = "0.2.0"
