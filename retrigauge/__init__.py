"""Retrieval evaluation over mixed corpora, written as PySpark DataFrame plans."""
