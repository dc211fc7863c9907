"""spanforge: interval, retrieval, trajectory and training-data analytics on PySpark."""

__version__ = "0.1.0"
