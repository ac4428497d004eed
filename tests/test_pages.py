"""Keyed processors without a stream: what they ask of the state store."""

import pickle
from operator import itemgetter

import pytest
from pyspark.sql import Row

from sluice.operators import MULT, Flow, consolidate
from sluice.streaming import processors, steps, stream_deltas
from sluice.streaming.processors import Count, Extreme, Join, Reduce


class Store:
    """One value, and the calls for it."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def feed(processor, store, names, rows):
    processor.exact = False
    processor.init(store)
    made = [tuple(r.asDict(True).values()) for r in processor.handleInputRows((0,), iter([Row(*names, MULT)(*r) for r in rows]), None)]
    return sorted(made, key=itemgetter(-1)), len(made)


MAKES = {
    "reduce": lambda: Reduce(lambda pairs: [((len(pairs),), 1)], ["k"], ["v"], ["k", "n"], False, ["k"]),
    "count": lambda: Count(["k"], ["v"], "n"),
    "extreme": lambda: Extreme(["k"], ["v"], True),
}


@pytest.mark.parametrize("name", MAKES)
def test_many_keys_are_one_value_of_the_store(name):
    store = Store()
    for step, moves in ((0, 1000), (1, 2000)):
        store.calls = []
        _, n = feed(MAKES[name](), store, ["k", "v"], [(k, step, 1) for k in range(1000)])
        assert n == moves and store.calls == ["get"] * step + ["update"]


def test_what_is_all_taken_back_leaves_no_state():
    store = Store()
    assert feed(MAKES["reduce"](), store, ["k", "v"], [("a", float("nan"), 1), ("b", 0.0, 1)])[0] == [("a", 1, 1), ("b", 1, 1)]
    assert feed(MAKES["reduce"](), store, ["k", "v"], [("a", float("nan"), -1), ("b", -0.0, -1)])[0] == [("a", 1, -1), ("b", 1, -1)]
    assert store.value is None and pickle.loads(pickle.dumps(processors._NAN)) is processors._NAN


def test_join_of_one_key_makes_its_pairs_once(monkeypatch):
    calls, add = [0], processors._add

    def counting(totals, v, m):
        calls[0] += 1
        add(totals, v, m)

    monkeypatch.setattr(processors, "_add", counting)
    names = ["k", "__side", "__l0", "__r0"]
    store = Store()
    n = 400
    assert feed(Join(["k"], ["a"], ["b"]), store, names, [("x", 0, i, None, 1) for i in range(n)] + [("x", 1, None, 7, 2)])[1] == n
    assert calls[0] == 3 * n + 2
    made, moves = feed(Join(["k"], ["a"], ["b"]), store, names, [("x", 1, None, 7, -2), ("x", 0, n, None, 1), ("x", 1, None, 8, 1)])
    assert moves == 2 * n + 1 and made[0] == ("x", 0, 7, -2) and ("x", n, 8, 1) in made


def test_a_frame_is_a_micro_batch_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(steps, "shared_folder", lambda *_: f"file://{tmp_path}")
    frames = [spark.range(k * 60, k * 60 + 60, 1, 3).selectExpr("id % 7 as k", "id as v") for k in range(2)]
    got = stream_deltas(frames, lambda f: f.group("k").max().ungroup_both(), 2)
    assert len(list((tmp_path / "in").glob("part-*"))) == 6
    assert got.filter("step = 0").count() == 7 and got.filter("step = 1").count() == 14
    assert sorted(map(tuple, consolidate(got.drop("step")).collect())) == sorted((v % 7, v, 1) for v in range(113, 120))
    assert Flow(got).columns == ["k", "v", "step"]


def test_distinct_keeps_totals_and_gives_changes_only():
    store = Store()
    present = processors.Present(["k"])
    assert feed(present, store, ["k"], [("a", 2), ("b", 1), ("b", -1)]) == ([("a", 1)], 1)
    assert feed(present, store, ["k"], [("a", -1), ("b", -3)]) == ([("b", 1)], 1)
    assert feed(present, store, ["k"], [("a", -1), ("b", 3)]) == ([("a", -1), ("b", -1)], 2) and store.value is None


def test_distinct_on_a_stream_runs_no_function_over_values(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sluice.streaming.reduced", None)
    flow = Flow(spark.readStream.schema("k string, v int").parquet(str(tmp_path)))
    assert flow.distinct().columns == flow.group("k").distinct().ungroup_both().columns == ["k", "v"]


def test_summary_keeps_one_row_for_a_key(spark, tmp_path):
    sizes, store = [], Store()
    for n in (10, 10_000):
        rows = [("x", i, f"n{i}", 1, 1) for i in range(n)]
        summary = processors.FirstAndSum(["k"], ["at", "name", "pcs"], ["k", "name", "total"])
        feed(summary, store, ["k", "at", "name", "pcs"], rows)
        sizes.append(len(store.value[0]))
    assert sizes[1] < sizes[0] + 8
    made, _ = feed(summary, store, ["k", "at", "name", "pcs"], [("x", None, "early", None, 1), ("y", 1, "b", None, 1), ("y", 1, None, None, 1)])
    assert sorted(made, key=str) == [("x", "early", 10_010, 1), ("x", "n0", 10_010, -1), ("y", None, None, 1)]
    from sluice.plans.examples import production_summary

    rows = spark.readStream.schema("k string, at long, name string, pcs long").parquet(str(tmp_path))
    assert production_summary(Flow(rows), ["k"], "name", "pcs", ["at"]).columns == ["k", "name", "total_pcs"]
