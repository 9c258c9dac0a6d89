"""Spark-first content analytics: text cleaning, enrichment, trust scoring."""
