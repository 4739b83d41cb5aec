"""Span detection, redaction, restoration and audit over Spark DataFrames."""

__version__ = "0.1.0"
