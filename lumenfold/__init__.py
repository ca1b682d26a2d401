"""Spark-first batch document intelligence: ingest, segment, section, extract, score."""
