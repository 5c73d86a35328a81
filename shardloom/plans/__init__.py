"""Queries over shards, built on the driver and run as one DataFrame."""
