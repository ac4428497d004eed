import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.operators import MULT, Flow, consolidate, union, weighted
from sluice.plans import Machine
from sluice.plans.machine import assert_deltas


def ints(spark, *xs):
    return spark.createDataFrame([(x, x % 5) for x in xs], "x int, k int")


STEPS = [(1,), (1,), (11, 2), (6, 7)]


def feed(spark, query, expected):
    machine = Machine(query)
    for xs, deltas in zip(STEPS, expected, strict=True):
        assert_deltas(machine.feed(ints(spark, *xs)).drain(), deltas)


def test_monotonic_max_by_steps(spark):
    feed(spark, lambda f: f.monotonic_max_by("k").map("x"), [[(1, 1)], [], [(1, -1), (2, 1), (11, 1)], [(2, -1), (7, 1)]])


def test_representative_steps(spark):
    rows = spark.createDataFrame([(i, x, x % 5, s) for i, (x, s) in enumerate([(1, 0), (1, 1), (11, 2), (2, 2), (6, 3), (7, 3)])], "i int, x int, k int, s int")
    machine = Machine(lambda f: f.monotonic_representative_by(["k"], ["i"]).map("x"))
    for s, deltas in enumerate([[(1, 1)], [], [(2, 1)], []]):
        assert_deltas(machine.feed(rows.filter(F.col("s") == s).drop("s")).drain(), deltas)


def test_monotonic_refuses_removal(spark):
    gone = ints(spark, 3).withColumn(MULT, F.lit(-1).cast("long"))
    with pytest.raises(Exception, match="can't take back"):
        Flow(gone).monotonic_max_by("k").df.collect()


def test_max_by_takes_greatest_of_ties(spark):
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 1, "c"), ("k", 0, "z")], "k string, r int, v string")
    assert [r.v for r in Flow(rows).group("k").max_by(F.col("r")).ungroup().df.collect()] == ["c"]


def test_nulls_are_smallest(spark):
    rows = spark.createDataFrame([("k", None), ("k", 1)], "k string, v int")
    assert Flow(rows).group("k").min().ungroup().df.first().v is None
    assert Flow(rows).group("k").max().ungroup().df.first().v == 1


def test_negative_totals(spark):
    rows = spark.createDataFrame([("a", "v", -2), ("b", "v", 1), ("b", "w", -1), ("c", "v", 1), ("c", "v", -1)], f"k string, v string, {MULT} long")
    flow = Flow(rows)
    assert sorted(map(tuple, flow.group("k").distinct().ungroup_both().df.collect())) == [("a", "v"), ("b", "v"), ("b", "w")]
    assert sorted(map(tuple, flow.group("k").count().ungroup_both().df.collect())) == [("a", -2), ("b", 0)]
    assert sorted(map(tuple, flow.distinct().df.collect())) == [("a", "v"), ("b", "v"), ("b", "w")]


def test_mut_keeps_state_per_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, k string")

    def first():
        seen = []

        def keep(row):
            seen.append(row)
            return len(seen) == 1

        return keep

    assert sorted(r.i for r in Flow(rows).filter_mut(first(), ["i"], ["k"]).df.collect()) == [1, 3]
    assert [r.i for r in Flow(rows).filter_mut(first(), ["i"]).df.collect()] == [1]


def test_empty_flow(spark):
    rows = spark.createDataFrame([], "x int, k int")
    for flow in (Flow(rows).distinct(), Flow(rows).count(), Flow(rows).group("k").max().ungroup(), Flow(rows).group("k").join_single(Flow(rows).map("k", F.col("x").alias("y")).group("k"), "k")):
        assert flow.df.count() == 0


QUERIES = {
    "count": lambda f: f.group("k").count().ungroup_both(),
    "max": lambda f: f.group("k").max().ungroup_both(),
    "distinct": lambda f: f.map("k").distinct(),
    "join": lambda f: f.group("k").join_single(f.map("k", F.col("x").alias("y")).group("k"), "k", "x", "y"),
}


@pytest.mark.parametrize("name", QUERIES)
@settings(max_examples=2, phases=[Phase.generate], deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.lists(st.tuples(st.integers(0, 6), st.sampled_from([1, 1, 2, -1])), min_size=1, max_size=5), min_size=2, max_size=2))
def test_deltas_add_up(spark, name, batches):
    query = QUERIES[name]
    frames = [spark.createDataFrame([(x, x % 3, m) for x, m in b], f"x int, k int, {MULT} long") for b in batches]
    machine, total = Machine(query, ["k"]), None
    for f in frames:
        deltas = machine.feed(f).drain()
        total = deltas if total is None else union([total, deltas])
    whole = frames[0]
    for f in frames[1:]:
        whole = union([whole, f])
    want = consolidate(weighted(query(Flow(whole)).df))
    cols = want.columns
    assert sorted(map(tuple, consolidate(total).select(cols).collect())) == sorted(map(tuple, want.collect()))


def test_linear_steps_evaluate_their_batch_alone(spark):
    names = Flow(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, name string")).group("k")
    query = lambda f: f.group("k").join_single(names, "k", "v", "name")
    batches = [spark.createDataFrame(r, f"k long, v long, {MULT} long") for r in ([(1, 1, 1), (2, 2, 1), (1, 1, 1)], [(2, 2, -1), (3, 1, 1)], [(1, 1, -1), (1, 5, 2)])]
    seen = []

    def counted(f):
        seen.append(f.df.count())
        return query(f)

    plain, linear = Machine(query, ["k"]), Machine(counted, ["k"], linear=True)
    for b in batches:
        want, got = (sorted(map(tuple, m.feed(b).drain().select("k", "v", "name", MULT).collect())) for m in (plain, linear))
        assert got == want and got
    assert seen == [3, 2, 2]
    both = Machine(lambda a, b: a.concat(b.negate()), inputs=2, linear=True)
    both.feed(batches[0]).feed(batches[1], 1).drain()
    assert sorted(map(tuple, both.feed(batches[2], 1).drain().collect())) == [(1, 1, 1), (1, 5, -2)]
