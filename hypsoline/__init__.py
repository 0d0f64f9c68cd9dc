"""Spark-first analytics over a technology property graph, filings, papers, news and event streams."""
