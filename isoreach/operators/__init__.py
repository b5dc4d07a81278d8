"""Relational building blocks: joins, lookups, reshaping, statistics, geometry."""
