"""Queries over the test tables, each with the SQL that gives its rows from the flat tables."""

from shardloom.queries import aggregation, catalog, filters, ids, joins, records  # noqa: F401
from shardloom.queries.base import ORACLES, QUERIES  # noqa: F401
