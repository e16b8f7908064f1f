"""isoframe: splicing analytics and interval algebra as Spark DataFrame operators."""

__version__ = "0.1.0"
