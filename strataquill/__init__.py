"""strataquill: a Spark-first engine for versioned, multilingual document corpora."""

__version__ = "0.1.0"
