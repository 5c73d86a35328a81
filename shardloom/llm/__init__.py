"""Operators for large training-data pipelines. Nothing else in shardloom imports this package."""
