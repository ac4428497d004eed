"""SQL tables kept equal to flows: descriptors, dialects and the transactional application of deltas."""

from sluice.sinks.dialect import MSSQL, POSTGRES, SQLITE, Dialect
from sluice.sinks.sql import SqlSink, mssql_sink, postgres_sink, sqlite_sink
from sluice.sinks.tables import ColumnSpec, TableSet, TableSpec

__all__ = ["MSSQL", "POSTGRES", "SQLITE", "ColumnSpec", "Dialect", "SqlSink", "TableSet", "TableSpec", "mssql_sink", "postgres_sink", "sqlite_sink"]
