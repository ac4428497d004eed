"""The example queries: machine dashboard, machine usage and production summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from sluice.functions.ordering import tagged_json
from sluice.operators import Flow, consolidate, expand, spare, weighted
from sluice.operators.weights import MULT
from sluice.sinks import ColumnSpec, TableSpec

SEMANTICS = "machineFish"
LOOK_BACK = "365 days"
EVENTS = {"started": {"order": "string"}, "stopped": {"order": "string"}}
IDLE, WORKING = 0, 1

DASHBOARD = TableSpec(
    "dashboard",
    1,
    (
        ColumnSpec("machine", "text not null", index=True),
        ColumnSpec("status", "text not null"),
        ColumnSpec("manufacturing_order", "text"),
        ColumnSpec("since", "timestamp with time zone"),
    ),
)
USAGE = TableSpec(
    "usage",
    1,
    (
        ColumnSpec("machine", "text not null", index=True),
        ColumnSpec("manufacturing_order", "text"),
        ColumnSpec("started", "timestamp with time zone", index=True),
        ColumnSpec("duration_micros", "bigint"),
    ),
)
SUMMARY = TableSpec(
    "production_summary",
    1,
    (
        ColumnSpec("article_id", "text not null", index=True),
        ColumnSpec("article_name", "text not null", index=True),
        ColumnSpec("workstation", "text not null", index=True),
        ColumnSpec("total_pcs", "bigint"),
    ),
)


def machine_record():
    """The decoded payload of a machine's event, null where it isn't one."""
    return tagged_json(F.col("payload"), "type", EVENTS)


def latest_status(events: Flow) -> Flow:
    """Per machine the status that began last.  events: machine, ordinal (IDLE or WORKING), order_no, since."""
    best = events.group("machine").max_by(F.col("since"))
    status = F.when(F.col("ordinal") == WORKING, "working").otherwise("idle").alias("status")
    return best.ungroup_with("machine", status, "order_no", "since")


def dashboard(events: Flow) -> Flow:
    """The dashboard over decoded machine events (envelope with ``record``); drills only."""
    started = F.col("record.type") == "started"
    rows = events.filter(F.col("stream_name").startswith("Drill")).map(
        F.col("stream_name").alias("machine"),
        F.when(started, WORKING).otherwise(IDLE).alias("ordinal"),
        F.when(started, F.col("record.order")).alias("order_no"),
        F.col("ts").alias("since"),
    )
    return latest_status(rows).map("machine", "status", F.col("order_no").alias("manufacturing_order"), F.unix_seconds("since").alias("since"))


def dashboard_of_a_year(events: Flow) -> Flow:
    """The dashboard as its program runs it: a restart looks back no more than a year."""
    return dashboard(Flow.new_limited(events.df, LOOK_BACK))


def paired(rows: DataFrame, keys: list[str], order: list[str], start: str, stop: str) -> DataFrame:
    """Each ``stop`` row whose predecessor of its key is a ``start`` row, with that row's ts as ``started``.

    A later start takes the place of an earlier one, and a stop uses its start up, so a stop's partner is exactly the row
    before it.
    """
    w, before = Window.partitionBy(*keys).orderBy(*order), spare(rows.columns, "__kind")
    pairs = rows.withColumns({before: F.lag("kind").over(w), "started": F.lag("ts").over(w)})
    return pairs.filter((F.col("kind") == stop) & (F.col(before) == start)).drop(before)


def paired_rows(rows: Flow, keys: list[str], order: list[str], start: str, stop: str) -> Flow:
    """As paired(), by a function of each key's rows, which streams can run: (keys, started, ts) with multiplicities."""

    def pairs(key, found):
        began = None
        for v, m in found:
            kind, ts = v[-2:]
            if m > 0 and kind == start:
                began = ts
            elif m > 0 and kind == stop and began is not None:
                yield (began, ts), 1
                began = None
            elif m > 0:
                began = None

    kind = rows.df.schema["ts"].dataType
    schema = StructType([StructField("started", kind), StructField("ts", kind)])
    return rows.map(*keys, *order, "kind", "ts").group(*keys).reduce_rows(pairs, schema).ungroup_both()


def usage(events: Flow) -> Flow:
    """How long drills worked on orders: (machine, manufacturing_order, started, duration_micros)."""
    rows = events.filter(F.col("stream_name").startswith("Drill")).map(
        F.col("stream_name").alias("machine"), F.col("record.order").alias("manufacturing_order"), F.col("record.type").alias("kind"), "ts", "lamport", "source", "offset"
    )
    took = (F.unix_micros("ts") - F.unix_micros("started")).alias("duration_micros")
    if rows.df.isStreaming:
        # Lamport time, source and offset tell a key's events apart and come before kind and ts
        out = paired_rows(rows, ["machine", "manufacturing_order"], ["lamport", "source", "offset"], "started", "stopped")
        return Flow(out.map("machine", "manufacturing_order", F.unix_seconds("started").alias("started"), took).df, True, events.look_back)
    plain = rows.df if rows.insert_only else consolidate(rows.df).filter(F.col(MULT) > 0).drop(MULT)
    out = paired(plain, ["machine", "manufacturing_order"], ["lamport", "source", "offset"], "started", "stopped")
    return Flow(out.select("machine", "manufacturing_order", F.unix_seconds("started").alias("started"), took), True, events.look_back)


def production_summary(rows: Flow, keys: list[str], name: str, pieces: str, order_by: list[str]) -> Flow:
    """Per key the name of the earliest row and the sum of its pieces, each times its multiplicity."""
    if rows.df.isStreaming:
        vals = [*order_by, name, pieces]
        if rows.insert_only:
            from sluice.streaming import first_and_sum

            return first_and_sum(rows, keys, order_by, name, pieces, "total_pcs")

        def summary(key, found):
            yield (found[0][0][-2], sum(m * v[-1] for v, m in found)), 1

        schema = StructType([rows.df.schema[name], StructField("total_pcs", LongType())])
        return rows.map(*keys, *(v for v in vals if v not in keys)).group(*keys).reduce_rows(summary, schema).ungroup_both()
    first = F.min_by(F.col(name), F.struct(*order_by, name)).alias(name)
    total = F.sum(F.col(MULT) * F.col(pieces)).cast("long").alias("total_pcs")
    return Flow(weighted(consolidate(rows.df) if not rows.insert_only else rows.df), rows.stateful).group(*keys).reduce(first, total).ungroup_both()


__all__ = ["DASHBOARD", "SUMMARY", "USAGE", "dashboard", "dashboard_of_a_year", "expand", "latest_status", "machine_record", "paired", "paired_rows", "production_summary", "usage"]
