"""Descriptors of target tables and the statements over a set of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from sluice.sinks.dialect import Dialect

VERSIONS = "_schema_versions"
OFFSETS = "offsets"
MOST = 5
_name = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _checked(name: str) -> str:
    if not _name.fullmatch(name):
        raise ValueError(f"{name!r} can't be a table's or column's name")
    return name


@dataclass(frozen=True)
class ColumnSpec:
    """index: part of the table's index.  exclude: made by the database, neither written nor compared."""

    name: str
    sql_type: str
    index: bool = False
    exclude: bool = False

    def __post_init__(self):
        _checked(self.name)
        if ";" in self.sql_type or "--" in self.sql_type:
            raise ValueError(f"{self.sql_type!r} can't be a column's type")


@dataclass(frozen=True)
class TableSpec:
    name: str
    version: int
    columns: tuple[ColumnSpec, ...]

    def __post_init__(self):
        _checked(self.name)

    @property
    def written(self) -> list[str]:
        """The columns that a row has values for, in order."""
        return [c.name for c in self.columns if not c.exclude]


@dataclass(frozen=True)
class TableSet:
    """Up to five tables that share a map of offsets; each row goes to one of them."""

    tables: tuple[TableSpec, ...]
    dialect: Dialect
    prefix: str = ""
    names: dict[str, str] = field(init=False)

    def __post_init__(self):
        if not 1 <= len(self.tables) <= MOST:
            raise ValueError(f"a set has 1 to {MOST} tables")
        if self.prefix:
            _checked(self.prefix)
        object.__setattr__(self, "names", {t.name: f"{self.prefix}_{t.name}" if self.prefix else t.name for t in self.tables})

    @property
    def offsets_table(self) -> str:
        return f"{self.names[self.tables[0].name]}_{OFFSETS}"

    @property
    def versions(self) -> dict[str, int]:
        return {self.names[t.name]: t.version for t in self.tables}

    def create_versions(self) -> str:
        return self.dialect.create_table(VERSIONS, "table_name varchar(200), version int not null")

    def select_versions(self) -> str:
        names = ", ".join(f"'{n}'" for n in self.names.values())
        return f"select table_name, version from {VERSIONS} where table_name in ({names})"

    def migration(self) -> list[str]:
        """Drops the tables and offsets and makes them anew."""
        out = []
        for name, version in self.versions.items():
            out += [
                f"delete from {VERSIONS} where table_name = '{name}'",
                f"insert into {VERSIONS} values ('{name}', {version})",
                f"drop table if exists {name}",
                f"drop table if exists {name}_{OFFSETS}",
                f"drop table if exists {name}_{OFFSETS}_batch",
            ]
        out.append(self.dialect.create_table(self.offsets_table, "source varchar(50) primary key, offset_ bigint"))
        out.append(self.dialect.create_table(f"{self.offsets_table}_batch", "checkpoint_ varchar(50), batch_id bigint"))
        for t in self.tables:
            name = self.names[t.name]
            out.append(self.dialect.create_table(name, ", ".join(f"{c.name} {c.sql_type}" for c in t.columns)))
            if indexed := [c.name for c in t.columns if c.index]:
                out.append(self.dialect.create_index(f"{name}_index", name, ", ".join(indexed)))
        return out

    def select_offsets(self) -> str:
        return f"select source, offset_ from {self.offsets_table}"

    def upsert_offset(self) -> str:
        return self.dialect.upsert_offset(self.offsets_table, self.dialect.hole)

    def insert(self, table: TableSpec) -> str:
        holes = ", ".join(self.dialect.hole(k + 1) for k in range(len(table.written)))
        return f"insert into {self.names[table.name]} ({', '.join(table.written)}) values ({holes})"

    def delete(self, table: TableSpec) -> str:
        n = len(table.written)
        same = " and ".join(self.dialect.equal(c, self.dialect.hole(k + 1)) for k, c in enumerate(table.written))
        return self.dialect.delete_some(f"from {self.names[table.name]} where {same}", self.dialect.hole(n + 1))
