"""An append-only event log of several sources.

Each event has its source's offset, a Lamport time for the causal order, a timestamp and an opaque JSON payload.  The
progress of a consumer is an offset map, source -> highest offset seen.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

ENVELOPE = StructType(
    [
        StructField("semantics", StringType()),
        StructField("stream_name", StringType()),
        StructField("source", StringType()),
        StructField("offset", LongType()),
        StructField("lamport", LongType()),
        StructField("ts", TimestampType()),
        StructField("payload", StringType()),
    ]
)
#: The causal order, total.
CAUSAL = ["lamport", "source", "offset"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as it stands (Parquet files of ENVELOPE)."""
    return spark.read.schema(ENVELOPE).parquet(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream of files."""
    reader = spark.readStream.schema(ENVELOPE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def subscribe(events: DataFrame, semantics: str | None = None, stream: str | None = None) -> DataFrame:
    """Events of some semantics and stream name; None takes all."""
    for column, value in (("semantics", semantics), ("stream_name", stream)):
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events


def present(events: DataFrame) -> DataFrame:
    """(source, offset): how far the log reaches."""
    return events.groupBy("source").agg(F.max("offset").alias("offset"))


def offsets(events: DataFrame) -> dict[str, int]:
    """As present(), as a map.  A row for each source reaches the driver."""
    return {r.source: r.offset for r in present(events).collect()}


#: Sources whose ranges stand in a filter one by one, as a scan can prune by.
FEW = 200


def _bounded(known: Mapping[str, int], above: bool, others: bool) -> Column:
    """Offsets above those of known (or up to them); ``others``: whether sources that it lacks are in."""
    source, offset = F.col("source"), F.col("offset")
    if len(known) > FEW:
        at = F.element_at(F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, int(v)))), source)
        return F.coalesce(offset > at if above else offset <= at, F.lit(others))
    out = ~source.isin(*known) if others and known else F.lit(others)
    for k, v in known.items():
        out = out | ((source == k) & (offset > int(v) if above else offset <= int(v)))
    return out


def between(events: DataFrame, low: Mapping[str, int] | None, high: Mapping[str, int] | None) -> DataFrame:
    """Events above ``low`` and up to ``high``; a source that low lacks starts at its beginning, one that high lacks is
    left out."""
    if low:
        events = events.filter(_bounded(low, True, True))
    if high is not None:
        events = events.filter(_bounded(high, False, False))
    return events


def look_back_bound(events: DataFrame, interval: str | None, now: Column | None = None) -> int | None:
    """The greatest Lamport time of an event that is older than the interval, None for none: a reverse causal scan that
    stops at the first such event sees what lies above."""
    if interval is None:
        return None
    limit = (now if now is not None else F.current_timestamp()) - F.expr(f"interval {interval}")
    return events.filter(F.col("ts") <= limit).agg(F.max("lamport").alias("bound")).first().bound


def looked_back(events: DataFrame, interval: str | None, now: Column | None = None) -> DataFrame:
    """What a reverse causal scan sees before the first event that is older than the interval: the events of greater
    Lamport time than any of those."""
    if interval is None:
        return events
    limit = (now if now is not None else F.current_timestamp()) - F.expr(f"interval {interval}")
    bound = events.filter(F.col("ts") <= limit).agg(F.max("lamport").alias("bound"))  # one row
    return events.join(F.broadcast(bound), F.col("bound").isNull() | (F.col("lamport") > F.col("bound"))).drop("bound")


def above(events: DataFrame, bound: int | None) -> DataFrame:
    """Events of a Lamport time above the bound."""
    return events if bound is None else events.filter(F.col("lamport") > bound)


def decode(events: DataFrame, decoded: Column, name: str = "record") -> tuple[DataFrame, DataFrame]:
    """(events with the decoded record, dead letters): what doesn't decode is set aside, never retried."""
    got = events.withColumn(name, decoded)
    return got.filter(F.col(name).isNotNull()), got.filter(F.col(name).isNull()).drop(name)


def route(events: DataFrame, inputs: list[Column]) -> DataFrame:
    """events with ``route``: the number, from 1, of the first input whose decoding isn't null, or null for none."""
    out = F.lit(None).cast("int")
    for k in range(len(inputs), 0, -1):
        out = F.when(inputs[k - 1].isNotNull(), F.lit(k)).otherwise(out)
    return events.withColumn("route", out)


def joint_look_back(intervals: list[str | None]) -> str | None:
    """Of several inputs: none if any has none, else the longest."""
    if any(i is None for i in intervals):
        return None
    return max(intervals, key=_seconds) if intervals else None


def _seconds(interval: str) -> float:
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    words = interval.lower().split()
    return sum(float(n) * unit[u.rstrip("s")] for n, u in zip(words[::2], words[1::2], strict=True))
