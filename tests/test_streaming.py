import datetime as dt

import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sluice.functions import tagged_json
from sluice.operators import MULT, Flow, consolidate, union, weighted
from sluice.plans import Machine
from sluice.plans.examples import DASHBOARD, USAGE, dashboard, dashboard_of_a_year, machine_record, production_summary, usage
from sluice.sinks import ColumnSpec, TableSpec, sqlite_sink
from sluice.sources import ENVELOPE, between, decode, joint_look_back, looked_back
from sluice.streaming import Export, catch_up, stream_deltas
from sluice.streaming.processors import _pack
from sluice.streaming.runner import print_duration

E = [
    (1, "Drill1", '{"type":"started","order":"A"}', 10),
    (2, "Drill1", '{"type":"started","order":"A"}', 12),
    (3, "Drill1", '{"type":"stopped","order":"A"}', 20),
    (4, "Drill1", '{"type":"stopped","order":"A"}', 21),
    (5, "Drill2", '{"type":"started","order":"B"}', 15),
    (6, "Mill1", '{"type":"started","order":"C"}', 16),
    (7, "Drill2", '{"bogus":1}', 17),
]


def log(spark, rows):
    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    return spark.createDataFrame([("machineFish", s, "src", n - 1, n, at(t), p) for n, s, p, t in rows], ENVELOPE)


BOARD = [("Drill1", "idle", None, 21), ("Drill2", "working", "B", 15)]


def test_batch_catch_up(spark):
    sink = sqlite_sink(":memory:", (DASHBOARD, USAGE))
    queries = {"dashboard": dashboard, "usage": lambda f: Flow(usage(f).df, True)}
    for rows in (E[:2], E[:6], E, E):
        assert catch_up(log(spark, rows), machine_record(), queries, sink) == {"src": len(rows) - 1}
    assert sorted(sink.db.execute("select * from dashboard").fetchall()) == BOARD
    assert sink.db.execute("select * from usage").fetchall() == [("Drill1", "A", 12, 8_000_000)]
    assert decode(log(spark, E), machine_record())[1].count() == 1 and sink.floored == 0


def test_stream_restart_and_offsets(spark, tmp_path):
    path, checkpoint, db = str(tmp_path / "log"), str(tmp_path / "checkpoint"), str(tmp_path / "x.db")
    log(spark, E[:3]).coalesce(1).write.parquet(path)
    sink = sqlite_sink(db, (DASHBOARD,))
    Export(spark, path, machine_record(), dashboard, "dashboard", sink, checkpoint).catch_up()
    assert sink.db.execute("select machine, status, since from dashboard").fetchall() == [("Drill1", "idle", 20)]
    assert sink.offsets() == {"src": 2}
    log(spark, E[3:]).coalesce(1).write.mode("append").parquet(path)
    again = sqlite_sink(db, (DASHBOARD,))
    export = Export(spark, path, machine_record(), dashboard, "dashboard", again, checkpoint)
    export.catch_up()
    assert sorted(again.db.execute("select * from dashboard").fetchall()) == BOARD
    assert again.offsets() == {"src": 6} and again.floored == 0 and export.count_dead_letters() == 1


def test_export_names_its_state_store(spark, tmp_path):
    """A session as it comes has a state store that keyed processors can't use."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        log(spark, E).coalesce(1).write.parquet(str(tmp_path / "log"))
        export = Export(spark, str(tmp_path / "log"), machine_record(), dashboard, "dashboard", sqlite_sink(":memory:", (DASHBOARD,)), str(tmp_path / "cp"))
        export.catch_up()
        assert sorted(export.sink.rows("dashboard")) == BOARD
    finally:
        spark.conf.set(name, before)


def run(spark, tmp_path, schema, batches, build):
    """The signed rows that a streaming flow gives for each batch of files."""
    path, out = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        flow = build(spark.readStream.schema(schema).parquet(path))
        got = []
        flow.df.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n, got=got: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(got))
    return out


def test_stream_join_retracts(spark, tmp_path):
    schema = f"side int, k string, v int, {MULT} long"

    def build(df):
        sides = [Flow(df.filter(F.col("side") == s).select("k", F.col("v").alias(n), MULT)).group("k") for s, n in ((0, "a"), (1, "b"))]
        return sides[0].join_single(sides[1], "k", "a", "b")

    got = run(spark, tmp_path, schema, [[(0, "k", 1, 1), (1, "k", 10, 2)], [(0, "k", 1, -1), (0, "k", 2, 1)]], build)
    assert got == [[("k", 1, 10, 2)], [("k", 1, 10, -2), ("k", 2, 10, 2)]]


def test_stream_chain_and_monotonic(spark, tmp_path):
    build = lambda df: Flow(df).group("k").count().regroup({"all": F.lit(1)}, {"n": F.col("n")}).max().ungroup()
    (tmp_path / "a").mkdir()
    got = run(spark, tmp_path / "a", "k string, v int", [[("x", 1), ("y", 1), ("y", 2)], [("x", 2), ("x", 3)]], build)
    assert got == [[(2, 1)], [(2, -1), (3, 1)]]
    (tmp_path / "b").mkdir()
    got = run(spark, tmp_path / "b", "k string, v int", [[("x", 1)], [("x", 0), ("x", 5)]], lambda df: Flow(df).monotonic_max_by("k"))
    assert got == [[("x", 1, 1)], [("x", 1, -1), ("x", 5, 1)]]


def test_look_back(spark):
    rows = log(spark, E)
    seen = looked_back(rows, "5 seconds", F.lit("1970-01-01 00:00:22").cast("timestamp"))
    assert sorted(r.lamport for r in seen.collect()) == []  # the last event, at 17, is older than the bound
    assert sorted(r.lamport for r in looked_back(rows.filter("lamport <= 4"), "5 seconds", F.lit("1970-01-01 00:00:22").cast("timestamp")).collect()) == [3, 4]
    assert joint_look_back(["7 days", "1 weeks 1 day"]) == "1 weeks 1 day" and joint_look_back(["7 days", None]) is None


TOTAL = StructType([StructField("n", LongType())])
VERBS = {
    "threshold": lambda f: f.map("k", "v").threshold(lambda m: F.when(m > 1, m - 1).otherwise(0)),
    "grouped_threshold": lambda f: f.group("k").threshold(lambda m: m * 2).ungroup_both(),
    "count": lambda f: f.map("k").count(),
    "distinct": lambda f: f.map("k").distinct(),
    "grouped_count": lambda f: f.group("k").count().ungroup_both(),
    "grouped_distinct": lambda f: f.group("k").distinct().ungroup_both(),
    "min": lambda f: f.group("k").min().ungroup_both(),
    "max": lambda f: f.group("k").max().ungroup_both(),
    "max_by": lambda f: f.group("k").max_by(F.col("v") % 3).ungroup_both(),
    "reduce_rows": lambda f: f.group("k").reduce_rows(lambda key, rows: [((sum(v[0] * m for v, m in rows),), 1)], TOTAL).ungroup_both(),
    "regroup": lambda f: f.group("k").count().regroup({"n": F.col("n")}, {"k": F.col("k")}).max().ungroup_both(),
}


@pytest.mark.parametrize("signed", [True, False])
def test_stream_deltas_add_up(spark, signed):
    """All stateful verbs in one stream: over random batches their deltas sum to the batch result."""
    rng = random.Random(signed)
    frames = [spark.createDataFrame([(rng.choice("abc"), rng.randrange(4), rng.choice([1, 1, 2, -1]) if signed else 1) for _ in range(14)], f"k string, v long, {MULT} long") for _ in range(3)]
    frames = frames if signed else [f.drop(MULT) for f in frames]

    def every(f):
        return [weighted(q(f).df).select(F.lit(name).alias("verb"), F.to_json(F.struct(*sorted(c for c in q(f).df.columns if c != MULT))).alias("row"), MULT) for name, q in VERBS.items()]

    got = consolidate(stream_deltas(frames, lambda f: Flow(union(every(f))), 2).drop("step"))
    want = consolidate(union(every(Flow(union(frames)))))
    got, want = (sorted(map(tuple, df.select("verb", "row", MULT).collect())) for df in (got, want))
    assert got == want and {v for v, _, _ in got} == set(VERBS)


def test_what_a_stream_cannot_take_back_is_refused(spark, tmp_path):
    flow = Flow(spark.readStream.schema("k string, v int").parquet(str(tmp_path)))
    with pytest.raises(NotImplementedError):
        flow.group("k").reduce(F.sum("v").alias("s"))
    with pytest.raises(NotImplementedError):
        flow.map_in_place_mut(lambda r: r, ["v"])


def test_state_keys_are_canonical():
    a, b = "x" * 30, "".join(["x"] * 30)
    assert _pack((a, a, 0.0, float("nan"), (1, None))) == _pack((a, b, -0.0, -float("nan"), [1, None]))
    assert _pack((1,)) != _pack(("1",))


def test_summary_as_a_stream_equals_batch(spark):
    rng = random.Random(4)
    frames = [spark.createDataFrame([(rng.choice("ab"), f"n{rng.randrange(9)}", rng.randrange(50), k * 20 + i) for i in range(12)], "article string, name string, pcs long, lamport long") for k in range(2)]
    build = lambda f: production_summary(f, ["article"], "name", "pcs", ["lamport"])
    got = consolidate(stream_deltas(frames, build, 2).drop("step")).select("article", "name", "total_pcs", MULT)
    assert sorted(map(tuple, got.collect())) == sorted((*r, 1) for r in build(Flow(union(frames))).df.select("article", "name", "total_pcs").collect())


QUERIES = {"dashboard": dashboard, "usage": usage}
TIMES = [("Drill1", "A", 12, 8_000_000)]


def test_export_of_two_tables_survives_a_lost_checkpoint(spark, tmp_path):
    path, checkpoint, db = str(tmp_path / "log"), str(tmp_path / "checkpoint"), str(tmp_path / "x.db")
    log(spark, E[:2]).coalesce(1).write.parquet(path)
    other = log(spark, E).withColumn("semantics", F.lit("other")).withColumn("source", F.lit("stranger"))
    other.coalesce(1).write.mode("append").parquet(path)
    export = lambda: Export(spark, path, machine_record(), QUERIES, None, sqlite_sink(db, (DASHBOARD, USAGE)), checkpoint, semantics="machineFish")
    one = export()
    one.catch_up()
    assert one.sink.rows("dashboard") == [("Drill1", "working", "A", 12)] and one.sink.rows("usage") == [] and one.sink.offsets() == {"src": 1}
    shutil.rmtree(checkpoint)
    log(spark, E[2:4]).coalesce(1).write.mode("append").parquet(path)
    two = export()
    two.catch_up()
    assert two.sink.rows("dashboard") == [("Drill1", "idle", None, 21)] and two.sink.rows("usage") == TIMES and two.sink.offsets() == {"src": 3}
    # the state is warm again: the next run takes back what the replay had seen
    log(spark, E[4:]).coalesce(1).write.mode("append").parquet(path)
    three = export()
    three.catch_up()
    assert sorted(three.sink.rows("dashboard")) == BOARD and three.sink.rows("usage") == TIMES and three.sink.offsets() == {"src": 6} and three.sink.floored == 0
    assert three.count_dead_letters() == 1


def test_follow_takes_in_what_comes(spark, tmp_path):
    path, db = str(tmp_path / "log"), str(tmp_path / "x.db")
    log(spark, E[:3]).coalesce(1).write.parquet(path)
    export = Export(spark, path, machine_record(), dashboard, "dashboard", sqlite_sink(db, (DASHBOARD,)), str(tmp_path / "cp"))
    running = export.follow()
    probe = Flow(spark.range(1)).probe().attach(running)
    try:
        log(spark, E[3:]).coalesce(1).write.mode("append").parquet(path)
        running.processAllAvailable()
        assert sorted(sqlite_sink(db, (DASHBOARD,)).rows("dashboard")) == BOARD
        assert not probe.less_than(1) and probe.less_than(probe.reached() + 1)
    finally:
        running.stop()


def test_look_back_limits_every_restart(spark):
    at = lambda s: F.lit(f"1970-01-01 00:00:{s}").cast("timestamp")
    limited = lambda f: dashboard(Flow.new_limited(f.df, "5 seconds"))
    sink = sqlite_sink(":memory:", (DASHBOARD,))
    catch_up(log(spark, E[:2]), machine_record(), {"dashboard": limited}, sink, at(13))
    assert sink.rows("dashboard") == [("Drill1", "working", "A", 12)]
    # the run sees event 2 again, and so takes its row back
    catch_up(log(spark, E[:3]), machine_record(), {"dashboard": limited}, sink, at(16))
    assert sink.rows("dashboard") == [("Drill1", "idle", None, 20)]
    # all that was known is older now: nothing is taken back
    catch_up(log(spark, E[:4]), machine_record(), {"dashboard": limited}, sink, at(50))
    assert sorted(sink.rows("dashboard")) == [("Drill1", "idle", None, 20), ("Drill1", "idle", None, 21)]
    # a stateless query reads new events only, of those the ones after the last that is older
    plain = TableSpec("plain", 1, (ColumnSpec("lamport", "bigint"),))
    sink = sqlite_sink(":memory:", (plain,))
    rows = lambda f: Flow.new_limited(f.df, "5 seconds").map("lamport")
    catch_up(log(spark, E[:4]), machine_record(), {"plain": rows}, sink, at(22))
    assert sorted(sink.rows("plain")) == [(3,), (4,)]
    catch_up(log(spark, E[:6]), machine_record(), {"plain": rows}, sink, at(21))
    assert sorted(sink.rows("plain")) == [(3,), (4,)]
    assert dashboard_of_a_year(Flow(log(spark, E[:1]).withColumn("record", machine_record()))).look_back == "365 days"


def test_several_inputs(spark):
    started, stopped = (tagged_json(F.col("payload"), "type", {k: {"order": "string"}}) for k in ("started", "stopped"))
    query = lambda a, b: a.map(F.lit("a").alias("kind"), F.col("order").alias("o")).concat(b.map(F.lit("b").alias("kind"), F.col("order").alias("o")))
    machine = Machine(query, inputs=2, look_backs=["7 days", "1 weeks 1 day"])
    rest = machine.feed_first(log(spark, E), [started, stopped])
    assert rest.count() == 1 and machine.look_back == "1 weeks 1 day" and not machine.needs_state(*(spark.createDataFrame([("a",)], "order string") for _ in range(2)))
    assert sorted(map(tuple, machine.drain().collect())) == [("a", "A", 2), ("a", "B", 1), ("a", "C", 1), ("b", "A", 2)] and machine.time == 1
    spec = TableSpec("both", 1, (ColumnSpec("kind", "text"), ColumnSpec("o", "text")))
    sink = sqlite_sink(":memory:", (spec,))
    record = lambda f, k: f.map(F.lit(k).alias("kind"), F.col("record.order").alias("o"))
    catch_up(log(spark, E), [started, stopped], {"both": lambda a, b: record(a, "a").concat(record(b, "b"))}, sink)
    assert sorted(sink.rows("both")) == [("a", "A"), ("a", "A"), ("a", "B"), ("a", "C"), ("b", "A"), ("b", "A")]


def test_offset_ranges(spark):
    rows = log(spark, E)
    for n in (1, 300):
        more = {f"x{k}": 5 for k in range(n)}
        assert sorted(r.lamport for r in between(rows, {"src": 2} | more, {"src": 4} | more).collect()) == [4, 5]
        assert between(rows, more, {"src": 1}).count() == 2 and between(rows, None, more).count() == 0
    assert [print_duration(x) for x in (5, 60, 3600, 93784)] == ["5s", "1m0s", "1h0m0s", "1d2h3m4s"]


def test_monotonic_removal_of_smaller_rows(spark):
    schema = f"k string, v int, {MULT} long"
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 1, -1)], schema)
    assert [r.v for r in Flow(rows).monotonic_max_by("k").df.collect()] == [2]
    with pytest.raises(Exception, match="can't take back"):
        Flow(spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, -1)], schema)).monotonic_max_by("k").df.collect()
