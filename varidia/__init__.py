"""Nucleotide diversity of pooled sequencing samples, as Spark DataFrame operations."""

__version__ = "0.1.0"
