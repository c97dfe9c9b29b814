"""readsieve: alignment filtering, coverage statistics and read assignment as Spark plans."""

__version__ = "0.1.0"
