"""Linked-read analytics on PySpark: reads and alignments as DataFrames, barcode operators as Catalyst plans."""

__version__ = "0.1.0"
