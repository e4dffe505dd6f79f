"""Veldra: document-retrieval analytics on PySpark."""
