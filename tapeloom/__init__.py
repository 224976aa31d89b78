"""Timeline analytics over large catalogues of recordings, written for Spark."""

__version__ = "0.1.0"
