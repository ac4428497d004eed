"""The multiplicity column and what is done with it.

A plain DataFrame counts each row once.  One with the column MULT is a signed multiset: equal rows add up, negative
numbers take rows away.  Flows leave the column out as long as they only insert.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULT = "__mult"


def values(df: DataFrame) -> list[str]:
    """The columns but for MULT."""
    return [c for c in df.columns if c != MULT]


def spare(columns: Iterable[str], name: str) -> str:
    """name, or one like it where a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def weighted(df: DataFrame) -> DataFrame:
    """df with MULT, as 1 where it isn't there."""
    return df if MULT in df.columns else df.withColumn(MULT, F.lit(1).cast("long"))


def union(frames: Iterable[DataFrame]) -> DataFrame:
    """The multiset sum, by name.

    Spark 4.1 takes a union's rows as partitioned if its inputs' are, though adaptive execution may have coalesced the
    inputs differently; an aggregate above then splits keys.  That setting is switched off for the session.
    """
    frames = list(frames)
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, frames)


def negate(df: DataFrame) -> DataFrame:
    return weighted(df).withColumn(MULT, -F.col(MULT))


def consolidate(df: DataFrame) -> DataFrame:
    """One row for each distinct element with its total; elements that cancel are gone."""
    cols = values(df)
    return weighted(df).groupBy(*cols).agg(F.sum(MULT).alias(MULT)).filter(F.col(MULT) != 0)


def expand(df: DataFrame) -> DataFrame:
    """As many copies of each row as its total says; totals below one give none."""
    cols = values(df)
    total = consolidate(df).filter(F.col(MULT) > 0)
    return total.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), MULT)).alias(spare(cols, "__copy"))).select(*cols)
