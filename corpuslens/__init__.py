"""Corpus audit jobs on PySpark: every operator is ``DataFrame -> DataFrame``."""
