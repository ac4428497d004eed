"""What differs between the databases, as functions from names to SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    """name: label for logs.  hole(n): the nth placeholder, from 1.  equal(column, hole): null-safe equality.
    delete_some(rest, hole): deletes matching rows, of which the last placeholder limits the number if ``limited``."""

    name: str
    hole: Callable[[int], str]
    create_table: Callable[[str, str], str]
    create_index: Callable[[str, str, str], str]
    equal: Callable[[str, str], str]
    delete_some: Callable[[str, str], str]
    upsert_offset: Callable[[str, Callable[[int], str]], str]
    limited: bool = False
    start: tuple[str, ...] = ()


def _on_conflict(table: str, hole: Callable[[int], str]) -> str:
    return f"insert into {table} (source, offset_) values ({hole(1)}, {hole(2)}) on conflict (source) do update set offset_ = excluded.offset_"


SQLITE = Dialect(
    name="SQLite",
    hole=lambda n: "?",
    create_table=lambda table, columns: f"create table if not exists {table} ({columns})",
    create_index=lambda index, table, columns: f"create index if not exists {index} on {table} ({columns})",
    equal=lambda column, hole: f"{column} is {hole}",
    delete_some=lambda rest, hole: f"delete {rest}",
    upsert_offset=_on_conflict,
    start=("pragma journal_mode = wal", "pragma synchronous = normal"),
)

POSTGRES = Dialect(
    name="PostgreSQL",
    hole=lambda n: f"${n}",
    create_table=SQLITE.create_table,
    create_index=SQLITE.create_index,
    equal=lambda column, hole: f"{column} is not distinct from {hole}",
    delete_some=SQLITE.delete_some,
    upsert_offset=_on_conflict,
)

MSSQL = Dialect(
    name="SQL Server",
    hole=lambda n: f"@P{n}",
    create_table=lambda table, columns: f"if object_id('{table}', 'U') is null create table {table} ({columns})",
    create_index=lambda index, table, columns: f"if indexproperty(object_id('{table}'), '{index}', 'IndexID') is null create index {index} on {table} ({columns})",
    # an intersection takes two nulls as equal
    equal=lambda column, hole: f"exists (select {column} intersect select {hole})",
    delete_some=lambda rest, hole: f"delete top ({hole}) {rest}",
    upsert_offset=lambda table, hole: (
        f"merge {table} with (holdlock) as t using (select {hole(1)} as source, {hole(2)} as offset_) as n on t.source = n.source"
        " when matched then update set offset_ = n.offset_ when not matched then insert (source, offset_) values (n.source, n.offset_);"
    ),
    limited=True,
    start=("set transaction isolation level serializable",),
)
