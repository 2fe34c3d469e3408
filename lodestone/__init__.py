"""Lodestone: retrieval, catalog, conversation and text operators as Spark DataFrame jobs."""
