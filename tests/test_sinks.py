import pytest

from sluice.sinks import MSSQL, POSTGRES, SQLITE, ColumnSpec, TableSet, TableSpec, mssql_sink, postgres_sink, sqlite_sink

RECORD = TableSpec("test_record", 1, (ColumnSpec("a", "text"), ColumnSpec("b", "integer")))
ROWS = [(("aa", 12), 1), (("bb", 14), 1), (("cc", 22), 1), (("dd", 11), 1)]


def table(sink):
    return sorted(sink.db.execute("select a, b from test_record").fetchall())


def test_store_and_take_back():
    sink = sqlite_sink(":memory:", (RECORD,))
    assert sink.migrated and sink.offsets() == {}
    sink.apply({"abc": 42, "def": 22}, {"test_record": [(r, 2 if r == ("aa", 12) else m) for r, m in ROWS]})
    assert sink.offsets() == {"abc": 42, "def": 22}
    assert table(sink) == [("aa", 12), ("aa", 12), ("bb", 14), ("cc", 22), ("dd", 11)]
    sink.apply({"abc": 43}, {"test_record": [(r, -1) for r, _ in ROWS]})
    assert table(sink) == [("aa", 12)]
    assert sink.offsets() == {"abc": 43, "def": 22} and sink.floored == 0
    sink.apply({}, {"test_record": [(("aa", 12), -3)]})
    assert table(sink) == [] and sink.floored == 2


def test_nulls_match_and_failures_leave_nothing():
    sink = sqlite_sink(":memory:", (RECORD,))
    sink.apply({}, {"test_record": [((None, 1), 1)]})
    sink.apply({}, {"test_record": [((None, 1), -1)]})
    assert table(sink) == []
    with pytest.raises(ValueError):
        sink.apply({"s": 1}, {"test_record": [(("x", 1), 1), (("y", 1), 0)]})
    assert table(sink) == [] and sink.offsets() == {}


def test_repeated_batch_is_skipped():
    sink = sqlite_sink(":memory:", (RECORD,))
    assert sink.apply({"s": 1}, {"test_record": ROWS}, batch_id=0)
    assert not sink.apply({"s": 1}, {"test_record": ROWS}, batch_id=0)
    assert len(table(sink)) == 4 and sink.last_batch() == 0


def test_version_change_rebuilds(tmp_path):
    path = str(tmp_path / "x.db")
    sink = sqlite_sink(path, (RECORD,))
    sink.apply({"s": 1}, {"test_record": ROWS})
    assert not sqlite_sink(path, (RECORD,)).migrated
    sink.db.close()
    newer = sqlite_sink(path, (TableSpec("test_record", 2, RECORD.columns),))
    assert newer.migrated and newer.offsets() == {} and table(newer) == []


@pytest.mark.parametrize(
    ("dialect", "insert", "delete"),
    [
        (SQLITE, "insert into p_t (a, b) values (?, ?)", "delete from p_t where a is ? and b is ?"),
        (POSTGRES, "insert into p_t (a, b) values ($1, $2)", None),
        (MSSQL, "insert into p_t (a, b) values (@P1, @P2)", None),
    ],
)
def test_statements(dialect, insert, delete):
    spec = TableSpec("t", 3, (ColumnSpec("a", "text", index=True), ColumnSpec("b", "bigint"), ColumnSpec("id", "serial", exclude=True)))
    tables = TableSet((spec,), dialect, "p")
    assert tables.insert(spec) == insert
    if delete:
        assert tables.delete(spec) == delete
    if dialect is MSSQL:
        assert tables.delete(spec) == "delete top (@P3) from p_t where exists (select a intersect select @P1) and exists (select b intersect select @P2)"
    if dialect is POSTGRES:
        assert tables.delete(spec) == "delete from p_t where a is not distinct from $1 and b is not distinct from $2"
    assert tables.offsets_table == "p_t_offsets" and tables.versions == {"p_t": 3}
    assert any("p_t_index" in s for s in tables.migration())


def test_names_are_checked():
    with pytest.raises(ValueError):
        ColumnSpec("a; drop table x", "text")
    with pytest.raises(ValueError):
        TableSet((RECORD,) * 6, SQLITE)


class Fake:
    """A database that speaks another dialect's driver, over an SQLite file; it can break off once."""

    def __init__(self, path, log):
        import sqlite3

        self.db, self.log = sqlite3.connect(path), log

    def cursor(self):
        return FakeCursor(self)

    def commit(self):
        self.db.commit()

    def rollback(self):
        self.db.rollback()

    def close(self):
        self.log.append("closed")
        self.db.close()


class FakeCursor:
    def __init__(self, of):
        self.of, self.cur = of, of.db.cursor()

    def _said(self, sql, args):
        import re

        self.of.log.append(sql)
        if "broken" in args:
            raise ConnectionError("the server is gone")
        sql = sql.replace("%s", "?")
        if m := re.match(r"delete top \(\?\) from (\w+) (.*)", sql):
            sql, args = f"delete from {m[1]} where rowid in (select rowid from {m[1]} {m[2]} limit ?)", (*args[1:], args[0])
        if m := re.match(r"merge (\w+) ", sql):
            sql = f"insert into {m[1]} values (?, ?) on conflict (source) do update set offset_ = excluded.offset_"
        sql = re.sub(r"^if (object_id|indexproperty).* is null create (table|index)", r"create \2 if not exists", sql)
        return ("select 1" if sql.startswith("set ") else sql), args

    def execute(self, sql, args=()):
        self.cur.execute(*self._said(sql, tuple(args)))
        self.rowcount = self.cur.rowcount

    def executemany(self, sql, rows):
        for r in rows:
            self._said(sql, tuple(r))
        self.cur.executemany(sql.replace("%s", "?"), rows)

    def fetchall(self):
        return self.cur.fetchall()


@pytest.mark.parametrize("make", [postgres_sink, mssql_sink])
def test_other_databases(make, tmp_path):
    log = []
    sink = make("host=x password=y", (RECORD,), "p", lambda: Fake(str(tmp_path / "x.db"), log))
    assert sink.migrated and not make("", (RECORD,), "p", lambda: Fake(str(tmp_path / "x.db"), log)).migrated
    sink.apply({"abc": 42, "def": 22}, {"test_record": [*[(r, 2 if r == ("aa", 12) else m) for r, m in ROWS], ((None, 1), 3)]}, 0, "c")
    sink.apply({"abc": 43}, {"test_record": [*[(r, -1) for r, _ in ROWS], ((None, 1), -2)]}, 1, "c")
    assert sorted(sink.rows("test_record"), key=str) == [("aa", 12), (None, 1)] and sink.offsets() == {"abc": 43, "def": 22} and sink.floored == 0
    with pytest.raises(ConnectionError):
        sink.apply({"abc": 50}, {"test_record": [(("broken", 1), 1)]}, 2, "c")
    assert log[-1] == "closed" and sink.offsets()["abc"] == 43 and sink.last_batch("c") == 1 and sink.last_batch("d") == -1
    assert sink.apply({"abc": 50}, {"test_record": [(("ok", 1), 2500)]}, 2, "c") and len(sink.rows("test_record")) == 2502
    assert "password" not in str(sink) and sink.name in ("PostgreSQL", "SQL Server")
