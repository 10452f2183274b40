"""Operators for training-data pipelines: privacy, duplicates, mixing, sharding, filters, crawl records."""
