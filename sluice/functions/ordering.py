"""Total orders over rows, and decoding of tagged JSON payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType


def ordered(columns: Sequence[str], first: Column | None = None, name: str = "__first") -> Column:
    """A struct whose order is that of the columns from left to right, nulls lowest; ``first`` takes precedence."""
    parts = [F.col(c) for c in columns]
    return F.struct(*([first.alias(name)] if first is not None else []), *parts)


def order_key(values: Sequence) -> tuple:
    """The same order for Python rows: nested rows field by field, None lowest."""
    return tuple((0,) if v is None else (1, order_key(v)) if isinstance(v, tuple | list) else (1, v) for v in values)


def tagged_json(payload: Column, tag: str, variants: Mapping[str, Mapping[str, DataType | str]]) -> Column:
    """Decodes an internally tagged JSON record: a struct of the tag and the union of the variants' fields.

    The result is null where the payload is no object, the tag names no variant or one of the variant's fields lacks or
    has another type.
    """
    fields: dict[str, DataType | str] = {}
    for more in variants.values():
        fields |= more
    schema = StructType().add(tag, StringType())
    for k, t in fields.items():
        schema = schema.add(k, t)
    got = F.from_json(payload, schema)
    whole = [got[tag].eqNullSafe(F.lit(name)) & _all(got[k].isNotNull() for k in own) for name, own in variants.items()]
    ok = whole[0]
    for w in whole[1:]:
        ok = ok | w
    return F.when(ok, got)


def matches_json(payload: Column, schema: StructType) -> Column:
    """The payload as a struct, null unless every field that isn't nullable is there."""
    got = F.from_json(payload, schema)
    return F.when(_all([got.isNotNull(), *(got[f.name].isNotNull() for f in schema if not f.nullable)]), got)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
