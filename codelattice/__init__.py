"""A code graph on Spark: symbols and calls as tables, and review questions as queries over them."""

__version__ = "0.1.0"
