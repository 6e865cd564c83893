"""Retrieval and hygiene over text and source-code corpora, as Spark plans."""
