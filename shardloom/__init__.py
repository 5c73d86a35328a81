"""shardloom: analytics over logically sharded data, written on PySpark."""

__version__ = "0.1.0"
