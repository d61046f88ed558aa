"""Pagemill: document-corpus processing as Spark DataFrame plans."""
