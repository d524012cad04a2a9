"""Spark-first analytics over job postings."""
