"""tessera: semantic retrieval, index analytics and corpus preparation on Spark."""

__version__ = "0.1.0"
