"""ravenna: building and evaluating text retrieval at dataset scale on PySpark."""

__version__ = "0.1.0"
