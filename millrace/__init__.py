"""Curation of tabular datasets as plain PySpark DataFrame transformations."""
