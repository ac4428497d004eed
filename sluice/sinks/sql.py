"""Applies consolidated deltas to SQL tables, together with the offsets, in one transaction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from sluice.sinks.dialect import MSSQL, POSTGRES, SQLITE
from sluice.sinks.tables import TableSet, TableSpec


#: Rows in one call of the driver.
CHUNK = 1000


class SqlSink:
    """A set of tables in a database reached through a DB-API connection.

    Opening it compares the stored table versions with the expected ones; on any difference all tables of the set and
    the offsets are dropped and made anew (``migrated`` is then true, and streaming state must be dropped as well).
    After an error of the database the connection is closed and the next call opens another.  ``floored`` counts removals
    of rows that weren't there.
    """

    def __init__(self, tables: TableSet, connect: Callable[[], object], paramstyle: str = "qmark", label: str = ""):
        self.tables, self.connect, self.style, self.label = tables, connect, paramstyle, label
        self.floored, self._db = 0, None
        cur = self.db.cursor()
        cur.execute(tables.create_versions())
        self.migrated = self._versions(cur) != tables.versions
        if self.migrated:
            for statement in tables.migration():
                cur.execute(statement)
        self.db.commit()

    @property
    def name(self) -> str:
        """The driver's name, for logs."""
        return self.tables.dialect.name

    def __str__(self) -> str:
        return f"{self.name} {self.label}: {', '.join(self.tables.names.values())}"

    @property
    def db(self):
        """The connection, opened where there is none."""
        if self._db is None:
            self._db = self.connect()
            cur = self._db.cursor()
            for statement in self.tables.dialect.start:
                cur.execute(statement)
        return self._db

    def _drop(self) -> None:
        db, self._db = self._db, None
        try:
            db.close()
        except Exception:
            pass  # it is broken already

    def _query(self, sql: str) -> list:
        try:
            cur = self.db.cursor()
            cur.execute(sql)
            return cur.fetchall()
        except Exception:
            self._drop()
            raise

    def _versions(self, cur) -> dict[str, int]:
        cur.execute(self.tables.select_versions())
        return dict(cur.fetchall())

    def _bound(self, sql: str) -> tuple[str, Callable[[tuple], tuple]]:
        """The statement as the driver wants it, and what makes its positional arguments; numbered holes may repeat."""
        holes = [int(n) - 1 for n in re.findall(r"(?:\$|@P)(\d+)", sql)]
        if not holes:
            return sql, tuple
        sql = re.sub(r"(?:\$|@P)\d+", "%s" if self.style in ("format", "pyformat") else "?", sql)
        return sql, lambda args: tuple(args[n] for n in holes)

    def _run(self, cur, sql: str, args: tuple) -> None:
        sql, order = self._bound(sql)
        cur.execute(sql, order(args))

    def offsets(self) -> dict[str, int]:
        return dict(self._query(self.tables.select_offsets()))

    def last_batch(self, checkpoint: str = "") -> int:
        """The number of the last micro-batch of a checkpoint that was applied, -1 for none."""
        found = self._query(f"select checkpoint_, batch_id from {self.tables.offsets_table}_batch")
        return next((n for c, n in found if c == checkpoint), -1)

    def checkpoint(self) -> str | None:
        """The checkpoint whose micro-batches were applied last."""
        found = self._query(f"select checkpoint_ from {self.tables.offsets_table}_batch")
        return found[0][0] if found else None

    def apply(self, offsets: Mapping[str, int], deltas: Mapping[str, Iterable[tuple[tuple, int]]], batch_id: int | None = None, checkpoint: str = "") -> bool:
        """Offsets first, then each table's (row, multiplicity) pairs, one commit.  A batch that is already in is skipped."""
        if batch_id is not None and batch_id <= self.last_batch(checkpoint):
            return False
        db = self.db
        try:
            cur = db.cursor()
            for source, offset in sorted(offsets.items()):
                self._run(cur, self.tables.upsert_offset(), (source, offset))
            for t in self.tables.tables:
                self._change(cur, t, deltas.get(t.name, ()))
            if batch_id is not None:
                cur.execute(f"delete from {self.tables.offsets_table}_batch")
                hole = self.tables.dialect.hole
                self._run(cur, f"insert into {self.tables.offsets_table}_batch values ({hole(1)}, {hole(2)})", (checkpoint, int(batch_id)))
            db.commit()
        except Refused:
            db.rollback()
            raise
        except BaseException:
            try:
                db.rollback()
            finally:
                self._drop()
            raise
        return True

    def _change(self, cur, table: TableSpec, deltas: Iterable[tuple[tuple, int]]) -> None:
        """Rows to insert go in chunks; a removal has to tell how many rows it found."""
        insert, order = self._bound(self.tables.insert(table))
        held: list[tuple] = []
        for row, m in deltas:
            row, copies = tuple(row), m
            if m == 0:
                raise Refused(f"{table.name}: a delta without effect, {row}")
            if m < 0:
                limit = (-m,) if self.tables.dialect.limited else ()
                self._run(cur, self.tables.delete(table), (*row, *limit))
                gone = cur.rowcount
                copies = 0 if limit else gone + m
                self.floored += max(0, -m - gone)
            for _ in range(max(0, copies)):
                held.append(order(row))
                if len(held) >= CHUNK:
                    cur.executemany(insert, held)
                    held = []
        if held:
            cur.executemany(insert, held)

    def rows(self, table: str) -> list[tuple]:
        """A table's rows as they are written, for small tables and tests."""
        spec = next(t for t in self.tables.tables if t.name == table)
        return [tuple(r) for r in self._query(f"select {', '.join(spec.written)} from {self.tables.names[table]}")]


class Refused(ValueError):
    """A delta that no table takes."""


def sqlite_sink(path: str, tables: tuple[TableSpec, ...], prefix: str = "") -> SqlSink:
    """A sink into an SQLite file, or ':memory:'."""
    import sqlite3

    return SqlSink(TableSet(tables, SQLITE, prefix), lambda: sqlite3.connect(path, check_same_thread=False), label=path)


def postgres_sink(dsn: str, tables: tuple[TableSpec, ...], prefix: str = "", connect: Callable[[], object] | None = None) -> SqlSink:
    """A sink into PostgreSQL, through psycopg or what ``connect`` gives."""
    if connect is None:
        import psycopg

        connect = lambda: psycopg.connect(dsn)
    return SqlSink(TableSet(tables, POSTGRES, prefix), connect, "pyformat")


def mssql_sink(dsn: str, tables: tuple[TableSpec, ...], prefix: str = "", connect: Callable[[], object] | None = None) -> SqlSink:
    """A sink into SQL Server, through pyodbc or what ``connect`` gives.  One writer is assumed."""
    if connect is None:
        import pyodbc

        connect = lambda: pyodbc.connect(dsn)
    return SqlSink(TableSet(tables, MSSQL, prefix), connect, "qmark")
