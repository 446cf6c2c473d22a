"""Text signals and relational helpers for corpus curation on Spark."""

__version__ = "0.1.0"
