"""tidemark: binary-market and training-data analytics on plain PySpark."""

__version__ = "0.1.0"
