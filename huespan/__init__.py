"""Similarity search over points in colour space, as Spark plans."""
