"""codegrain: a PySpark engine for source-text corpora."""

__version__ = "0.1.0"
