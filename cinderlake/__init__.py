"""Corpus-scale artifact-risk analytics on PySpark."""
