"""Keeping SQL tables equal to queries over the event log.

``Export`` runs the queries as one stream: what lies in the log is caught up in bounded micro-batches, then the tail is
followed.  ``catch_up`` does one step in batch: the queries over the log up to now less the queries over the log up to the
stored offsets.  Both hand consolidated deltas and the new offset map to a sink, which commits them in one transaction.

Look-back limits what a restart reads again.  A stateful query whose state has to be made anew sees, of the events up to
the stored offsets, those after the last one that is older; a stateless query reads nothing again, and of the new events
those after the last one that is older.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import MULT, Flow, consolidate, negate, spare, union, weighted
from sluice.sinks import SqlSink
from sluice.sources import above, between, joint_look_back, look_back_bound, offsets, read_log, route, stream_log, subscribe
from sluice.sources.folders import read_text, remove, write_text
from sluice.streaming.processors import use_rocksdb

#: Seconds between flushes when following the tail.
TICK = 5
#: Files of the log that a micro-batch takes while catching up.
FILES = 1

Query = Callable[..., Flow]


def _rows(df: DataFrame, columns: list[str]):
    """(row, multiplicity) pairs, fetched partition by partition."""
    return ((tuple(r)[:-1], r[-1]) for r in df.select(*columns, MULT).toLocalIterator(prefetchPartitions=True))


def _flows(events: DataFrame, inputs: Sequence[Column]) -> list[Flow]:
    """One flow for each input: the events that it is the first to decode, with their record."""
    if len(inputs) == 1:
        return [Flow(events.withColumn("record", inputs[0]).filter("record is not null"))]
    by = spare(events.columns, "route")
    routed = route(events, list(inputs)).withColumnRenamed("route", by)
    return [Flow(routed.filter(F.col(by) == k + 1).withColumn("record", d).drop(by)) for k, d in enumerate(inputs)]


def _inputs(record: Column | Sequence[Column]) -> list[Column]:
    return [record] if isinstance(record, Column) else list(record)


def changes(events: DataFrame, inputs: Sequence[Column], query: Query, known: Mapping[str, int], now: Mapping[str, int], at: Column | None = None) -> DataFrame:
    """What the query gives between two offset maps, in consolidated deltas.  at: the present time, for look-back."""
    made = query(*_flows(events, inputs))
    if not made.stateful:
        new = between(events, known, now)
        return consolidate(weighted(query(*_flows(above(new, look_back_bound(new, made.look_back, at)), inputs)).df))
    if known:
        events = above(events, look_back_bound(between(events, None, known), made.look_back, at))
    after = weighted(query(*_flows(between(events, None, now), inputs)).df)
    if not known:
        return consolidate(after)
    return consolidate(union([after, negate(query(*_flows(between(events, None, known), inputs)).df)]))


def catch_up(events: DataFrame, record: Column | Sequence[Column], queries: Mapping[str, Query], sink: SqlSink, at: Column | None = None) -> dict[str, int]:
    """Brings the sink's tables up to the log; gives the new offsets.

    record: the decoder, or one for each input of the queries, of which the first that takes an event gets it.
    Undecodable events count towards the offsets and are left out.
    """
    known, now = sink.offsets(), offsets(events)
    if known == now:
        return now
    deltas = {}
    for t in sink.tables.tables:
        if t.name in queries:
            deltas[t.name] = _rows(changes(events, _inputs(record), queries[t.name], known, now, at), t.written)
    sink.apply(now, deltas)
    return now


class Export:
    """A streaming export of queries into a sink's tables.

    The sink keeps the number of the last micro-batch and the checkpoint that it belongs to, so a repeated micro-batch is
    harmless.  A sink that was migrated has lost its tables and offsets, so the checkpoint is dropped with them and the log
    is read anew.  If the checkpoint is lost instead, the log is replayed into a new one without output, and then what the
    log has gained since the stored offsets is applied.
    """

    def __init__(
        self,
        spark: SparkSession,
        log: str,
        record: Column | Sequence[Column],
        query: Query | Mapping[str, Query],
        table: str | None,
        sink: SqlSink,
        checkpoint: str,
        semantics: str | None = None,
        stream: str | None = None,
        at: Column | None = None,
    ):
        """query: of one table, or queries by table; semantics, stream: the subscription, None for all; at: the present time
        from which queries look back, None for the clock's."""
        self.spark, self.log, self.inputs, self.sink, self.checkpoint = spark, log, _inputs(record), sink, checkpoint.rstrip("/")
        self.queries = dict(query) if isinstance(query, Mapping) else {table: query}
        self.semantics, self.stream, self.at = semantics, stream, at
        self.dead_letters = 0
        if sink.migrated:
            remove(spark, self.checkpoint)

    def _subscribed(self, events: DataFrame) -> DataFrame:
        return subscribe(events, self.semantics, self.stream)

    def _log(self) -> DataFrame:
        return self._subscribed(read_log(self.spark, self.log))

    def _id(self) -> str:
        """The checkpoint's own id, which goes with its folder."""
        name = f"{self.checkpoint}/sluice.id"
        found = read_text(self.spark, name)
        if found is None:
            found = uuid.uuid4().hex
            write_text(self.spark, name, found)
        return found

    def _columns(self, table: str) -> list[str]:
        return next(t for t in self.sink.tables.tables if t.name == table).written

    def _start(self, live: bool, files: int | None, bound: int | None, take: Callable[[dict, dict, int], None]):
        """take(offsets reached, deltas by table, number of the micro-batch)."""
        use_rocksdb(self.spark)
        events = above(self._subscribed(stream_log(self.spark, self.log, files)), bound)
        outs = {t: weighted(q(*_flows(events, self.inputs)).df).select(*self._columns(t), MULT) for t, q in self.queries.items()}
        kinds = {t: "struct<" + ",".join(f"`{c}`:{k}" for c, k in df.dtypes if c != MULT) + ">" for t, df in outs.items()}
        # each table's rows are a column of their own; the offsets of all events of a micro-batch travel beside them
        parts = [
            df.select(*((F.struct(*self._columns(t)) if t == u else F.lit(None).cast(kinds[u])).alias(f"t{k}") for k, u in enumerate(outs)), MULT, F.lit(t).alias("to"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("offset"))
            for t, df in outs.items()
        ]
        seen = events.select(*(F.lit(None).cast(kinds[u]).alias(f"t{k}") for k, u in enumerate(outs)), F.lit(0).cast("long").alias(MULT), F.lit(None).cast("string").alias("to"), "source", "offset")

        def apply(df: DataFrame, batch: int) -> None:
            df = df.persist()
            try:
                reached = {r.source: r.offset for r in df.filter("source is not null").groupBy("source").agg(F.max("offset").alias("offset")).collect()}
                deltas = {t: consolidate(df.filter(F.col("to") == t).select(f"t{k}.*", MULT)) for k, t in enumerate(outs)}
                take(reached, deltas, batch)
            finally:
                df.unpersist()

        writer = union([*parts, seen]).writeStream.outputMode("update").option("checkpointLocation", self.checkpoint).foreachBatch(apply)
        return writer.trigger(**({"processingTime": f"{TICK} seconds"} if live else {"availableNow": True})).start()

    def _apply(self, reached: dict, deltas: dict, batch: int) -> None:
        self.sink.apply(self._furthest(reached), {t: _rows(df, self._columns(t)) for t, df in deltas.items()}, batch, self._id())

    def _furthest(self, reached: dict[str, int]) -> dict[str, int]:
        """Offsets never go back, in whatever order the log's files come."""
        known = self.sink.offsets()
        return {s: max(o, known.get(s, o)) for s, o in reached.items()}

    def _flow(self) -> tuple[bool, str | None]:
        """Whether any query is stateful, and their joint look-back."""
        made = [q(*_flows(self._log(), self.inputs)) for q in self.queries.values()]
        return any(f.stateful for f in made), joint_look_back([f.look_back for f in made])

    def _warm_up(self, files: int | None) -> None:
        """Replays the log into a new checkpoint and applies what it has gained since the stored offsets."""
        remove(self.spark, self.checkpoint)
        known, events = self.sink.offsets(), self._log()
        stateful, back = self._flow()
        bound = look_back_bound(between(events, None, known) if stateful else between(events, known, None), back, self.at)
        reached, last = dict(known), [-1]

        def skip(now: dict, deltas: dict, batch: int) -> None:
            for df in deltas.values():
                df.write.format("noop").mode("overwrite").save()
            reached.update({s: max(o, reached.get(s, o)) for s, o in now.items()})
            last[0] = batch

        self._id()
        self._start(False, files, bound, skip).awaitTermination()
        deltas = {t: _rows(changes(events, self.inputs, q, known, reached, self.at), self._columns(t)) for t, q in self.queries.items()}
        self.sink.apply(reached, deltas, max(0, last[0]), self._id())

    def _prepare(self, files: int | None) -> int | None:
        """The Lamport time from which a fresh stream of a stateless query with look-back starts, None for all."""
        fresh = read_text(self.spark, f"{self.checkpoint}/sluice.id") is None
        known = self.sink.offsets()
        if known and self.sink.checkpoint() != (None if fresh else self._id()):
            self._warm_up(files)
            return None
        if fresh and not known:
            stateful, back = self._flow()
            return None if stateful else look_back_bound(self._log(), back, self.at)
        return None

    def catch_up(self, files: int | None = FILES) -> None:
        """Takes in what lies in the log and ends."""
        bound = self._prepare(files)
        self._start(False, files, bound, self._apply).awaitTermination()

    def follow(self):
        """Catches up, then follows the tail; gives the running query."""
        self.catch_up()
        return self._start(True, None, None, self._apply)

    def count_dead_letters(self) -> int:
        """Events of the subscription that no input decodes."""
        self.dead_letters = route(self._log(), self.inputs).filter("route is null").count()
        return self.dead_letters


def print_duration(seconds: int) -> str:
    """As 1d2h3m4s, leading zero parts left out."""
    out = ""
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        n, seconds = divmod(seconds, size)
        if n or out or unit == "s":
            out += f"{n}{unit}"
    return out
