"""Corpus analytics, retrieval and evaluation operators as Spark DataFrame jobs."""
