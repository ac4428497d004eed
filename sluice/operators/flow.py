"""The verbs of a flow.

Expressions are Columns, so whole plans stay within Catalyst.  Python functions are taken where the semantics ask for
them: ``reduce_rows`` and the ``*_mut`` verbs, whose functions keep state between rows.  On streaming DataFrames the
stateless verbs are the same and the stateful ones become keyed processors (sluice.streaming); ``reduce`` with built-in
aggregates and the ``*_mut`` verbs can't, and say so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sluice.functions.ordering import order_key, ordered
from sluice.operators.weights import MULT, consolidate, negate, spare, union, values, weighted


class Probe:
    """How far a running flow has come: times are a machine's steps or a streaming query's micro-batches, from 0."""

    def __init__(self):
        self.of = None

    def attach(self, running) -> Probe:
        """running: a Machine or a StreamingQuery over the flow."""
        self.of = running
        return self

    def reached(self) -> int:
        """The number of steps that are through."""
        if self.of is None:
            return 0
        if hasattr(self.of, "lastProgress"):
            last = self.of.lastProgress
            return 0 if last is None else last["batchId"] + 1
        return self.of.time

    def less_than(self, time: int) -> bool:
        """Whether the output hasn't reached the time yet."""
        return self.reached() < time


class Flow:
    """A signed multiset of rows.

    stateful: whether results depend on earlier rows, so that a restart must replay or restore them.
    look_back: how far (an interval like '7 days') a restart needs to go back, None for all.
    """

    def __init__(self, df: DataFrame, stateful: bool = False, look_back: str | None = None):
        self.df, self.stateful, self.look_back = df, stateful, look_back

    @classmethod
    def new(cls, df: DataFrame) -> Flow:
        return cls(df)

    @classmethod
    def new_limited(cls, df: DataFrame, look_back: str) -> Flow:
        """The source applies the limit (sluice.sources.looked_back), not the flow."""
        return cls(df, look_back=look_back)

    @property
    def columns(self) -> list[str]:
        return values(self.df)

    @property
    def insert_only(self) -> bool:
        return MULT not in self.df.columns

    def _with(self, df: DataFrame, stateful: bool | None = None) -> Flow:
        return Flow(df, self.stateful if stateful is None else stateful, self.look_back)

    # --- stateless ---

    def filter(self, condition: Column | str) -> Flow:
        return self._with(self.df.filter(condition))

    def map(self, *columns: Column | str) -> Flow:
        """One row for each row; rows may become equal."""
        return self._with(self.df.select(*columns, *self._mult()))

    def map_in_place(self, **columns: Column) -> Flow:
        return self._with(self.df.withColumns(columns))

    def flat_map(self, items: Column, name: str, *keep: Column | str) -> Flow:
        """A row for each element of an array column, after the columns kept; no row for an empty or null array."""
        return self._with(self.df.select(*keep, F.explode(items).alias(name), *self._mult()))

    def negate(self) -> Flow:
        return self._with(negate(self.df))

    def concat(self, other: Flow) -> Flow:
        return self.concat_many([other])

    def concat_many(self, others: Iterable[Flow]) -> Flow:
        flows = [self, *others]
        plain = all(f.insert_only for f in flows)
        frames = [f.df if plain else weighted(f.df) for f in flows]
        return self._with(union(frames), any(f.stateful for f in flows))

    def inspect(self, name: str, *metrics: Column) -> Flow:
        """Observes the rows as they are, before consolidation; metrics arrive at the session's listeners."""
        return self._with(self.df.observe(name, *(metrics or (F.count(F.lit(1)).alias("rows"), (F.sum(MULT) if not self.insert_only else F.count(F.lit(1))).alias("total")))))

    def inspect_mut(self, function: Callable[[dict, int], None], order_by: list[str], key: list[str] | None = None) -> Flow:
        """Calls function(row, multiplicity) for each row in order; see map_mut."""

        def same(row: dict, m: int) -> Iterator[dict]:
            function(row, m)
            yield row

        return self._mut(same, order_by, key, self._schema())

    def probe(self) -> Probe:
        """A handle on the progress of what runs this flow; attach() names that."""
        return Probe()

    def output(self) -> DataFrame:
        """The rows with their multiplicities, not consolidated."""
        return weighted(self.df)

    def _mult(self) -> list[str]:
        return [] if self.insert_only else [MULT]

    def _schema(self) -> StructType:
        return StructType([f for f in self.df.schema if f.name != MULT])

    # --- functions with state between rows ---

    def filter_mut(self, function: Callable[[dict], bool], order_by: list[str], key: list[str] | None = None) -> Flow:
        def some(row: dict, m: int) -> Iterator[dict]:
            if function(row):
                yield row

        return self._mut(some, order_by, key, self._schema())

    def map_mut(self, function: Callable[[dict], dict], schema: StructType, order_by: list[str], key: list[str] | None = None) -> Flow:
        """function sees rows one by one in the order given and may keep state.

        With ``key``, each key has a fresh copy of the function and keys run side by side.  Without, the order is global
        and so all rows pass through one task: the meaning leaves no other way.
        """

        def one(row: dict, m: int) -> Iterator[dict]:
            yield function(row)

        return self._mut(one, order_by, key, schema)

    def map_in_place_mut(self, function: Callable[[dict], dict], order_by: list[str], key: list[str] | None = None) -> Flow:
        return self.map_mut(function, self._schema(), order_by, key)

    def flat_map_mut(self, function: Callable[[dict], Iterable[dict]], schema: StructType, order_by: list[str], key: list[str] | None = None) -> Flow:
        return self._mut(lambda row, m: iter(function(row)), order_by, key, schema)

    def _mut(self, function, order_by: list[str], key: list[str] | None, schema: StructType) -> Flow:
        if self.df.isStreaming:
            raise NotImplementedError("a function with state between rows sees a batch as a whole; use reduce_rows on a stream")
        import pyspark.cloudpickle as pickle

        raw = pickle.dumps(function)
        full = StructType([*schema.fields, StructField(MULT, LongType())])
        names = [f.name for f in full]

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds, state, call = to_arrow_schema(full), object(), None
            for b in batches:
                out: list[dict] = []
                for row in b.to_pylist():
                    now = tuple(row[k] for k in key) if key else ()
                    if now != state:
                        state, call = now, pickle.loads(raw)
                    m = row.pop(MULT)
                    out += [made | {MULT: m} for made in call(dict(row), m)]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kinds.field(n).type) for n in names], schema=kinds)

        df = weighted(self.df)
        df = (df.repartition(*key) if key else df.repartition(1)).sortWithinPartitions(*(key or []), *order_by)
        out = df.mapInArrow(run, full)
        return self._with(out.drop(MULT) if self.insert_only else out, True)

    # --- whole elements as keys ---

    def distinct(self) -> Flow:
        """Each element whose total isn't zero, once."""
        if self.df.isStreaming:
            from sluice.streaming import present

            return present(self)
        return self._with(self.df.distinct() if self.insert_only else consolidate(self.df).drop(MULT), True)

    def threshold(self, function: Callable[[Column], Column]) -> Flow:
        """Each element's multiplicity as a function of its total; zero removes it."""
        if self.df.isStreaming:
            return self._with(_thresholds(self.count(name := spare(self.columns, "__total")).df, name, function), True)
        total = consolidate(self.df)
        return self._with(total.withColumn(MULT, function(F.col(MULT)).cast("long")).filter(F.col(MULT) != 0), True)

    def count(self, name: str = "n") -> Flow:
        """Each element with its total, once."""
        if self.df.isStreaming:
            from sluice.streaming import counted

            return counted(self, self.columns, name, of_rows=False)
        return self._with(consolidate(self.df).withColumnRenamed(MULT, name), True)

    # --- grouping ---

    def group_by(self, **keys: Column) -> Grouped:
        """Groups whole rows under computed keys; a key may have the name of the column that it is."""
        own = self.columns
        new = {k: c for k, c in keys.items() if k not in own}
        return Grouped(self._with(self.df.withColumns(new)), list(keys), own)

    def group(self, *keys: str) -> Grouped:
        """Groups by columns; the others are the values."""
        return Grouped(self, list(keys), [c for c in self.columns if c not in keys])

    def monotonic_max_by(self, *keys: str) -> Flow:
        """The greatest row of each key, whatever the rows' multiplicities, for flows that grow: the removal of a smaller row
        goes unnoticed, that of the greatest row of a batch is an error."""
        if self.df.isStreaming:
            from sluice.streaming import monotonic_max

            return monotonic_max(self, list(keys))
        v, gone = spare(self.columns, "v"), spare(self.columns, "__gone")
        if self.insert_only:
            best = self.df.groupBy(*keys).agg(F.max(ordered(self.columns)).alias(v))
        else:
            # of equal rows a removal comes last, so the greatest tells whether it was taken back
            best = self.df.withColumn(gone, F.col(MULT) < 0).groupBy(*keys).agg(F.max(ordered([*self.columns, gone])).alias(v))
            fail = F.raise_error(F.concat(F.lit("a monotonic operator can't take back the greatest row "), F.to_json(v)))
            best = best.filter(F.when(F.col(v)[gone], fail.cast("boolean")).otherwise(F.lit(True)))
        return Flow(best.select(*(F.col(v)[c].alias(c) for c in self.columns)), True, self.look_back)

    def monotonic_representative_by(self, keys: list[str], order_by: list[str]) -> Flow:
        """The first row of each key in a total order that stands for the order of arrival.  A removal is an error."""
        if self.df.isStreaming:
            from sluice.streaming import representative

            return representative(self, keys, order_by)
        rest, v = [c for c in self.columns if c not in order_by], spare(self.columns, "v")
        first = self._guarded().groupBy(*keys).agg(F.min(ordered([*order_by, *rest])).alias(v))
        return Flow(first.select(*(F.col(v)[c].alias(c) for c in self.columns)), True, self.look_back)

    def _guarded(self) -> DataFrame:
        if self.insert_only:
            return self.df
        fail = F.raise_error(F.concat(F.lit("a monotonic operator can't take back "), F.to_json(F.struct(*self.columns))))
        return self.df.filter(F.when(F.col(MULT) < 0, fail.cast("boolean")).otherwise(F.col(MULT) > 0))


def _thresholds(counts: DataFrame, total: str, function: Callable[[Column], Column]) -> DataFrame:
    """A stream of totals with its retractions as multiplicities: the old total's is taken back, the new one's given."""
    m = F.coalesce(function(F.col(total)).cast("long"), F.lit(0))
    return counts.withColumn(MULT, F.col(MULT) * m).drop(total).filter(F.col(MULT) != 0)


class Grouped:
    """Rows by key; each distinct value of a key has a total multiplicity.  Keys and values may share columns."""

    def __init__(self, flow: Flow, keys: list[str], vals: list[str]):
        self.flow, self.keys, self.vals = flow, keys, vals

    @property
    def _all(self) -> list[str]:
        return [*self.keys, *(v for v in self.vals if v not in self.keys)]

    def _totals(self) -> DataFrame:
        """(key, value) pairs that are there, with totals."""
        return consolidate(self.flow.df.select(*self._all, *self.flow._mult()))

    def _present(self) -> DataFrame:
        """Rows to take extremes over; totals matter only where rows can be taken back."""
        return self.flow.df if self.flow.insert_only else self._totals()

    def _to(self, df: DataFrame, vals: list[str]) -> Grouped:
        return Grouped(self.flow._with(df, True), self.keys, vals)

    def _streamed(self, function, schema: StructType, vals: list[str]) -> Grouped:
        from sluice.streaming import reduced

        return Grouped(reduced(Flow(self.flow.df.select(*self._all, *self.flow._mult()), self.flow.stateful, self.flow.look_back), self.keys, function, schema, vals=self.vals), self.keys, vals)

    def _fields(self, *names: str) -> list[StructField]:
        return [self.flow.df.schema[n] for n in names]

    def reduce(self, *aggregates: Column) -> Grouped:
        """Built-in aggregates over a key's rows; MULT holds each row's multiplicity (``weighted`` is applied).

        An aggregate can't take back what it gave, so on streams ``reduce_rows`` has to say the same.
        """
        if self.flow.df.isStreaming:
            raise NotImplementedError("reduce gives no retractions on a stream; use reduce_rows")
        out = weighted(self.flow.df).groupBy(*self.keys).agg(*aggregates)
        return self._to(out, [c for c in out.columns if c not in self.keys])

    def reduce_rows(self, function: Callable[[tuple, list[tuple[tuple, int]]], Iterable[tuple[tuple, int]]], schema: StructType) -> Grouped:
        """function(key, [(value, total)] in the values' order) gives rows of ``schema`` with multiplicities.

        A key's distinct values are held by one worker; prefer ``reduce`` where an aggregate can say it.
        """
        vals, keys = self.vals, self.keys
        full = StructType([*self._fields(*keys), *schema.fields, StructField(MULT, LongType())])
        if self.flow.df.isStreaming:
            return self._streamed(lambda rows, key: list(function(key, rows)), schema, [f.name for f in schema])

        def run(table: pa.Table) -> pa.Table:
            from pyspark.sql.pandas.types import to_arrow_schema

            rows = table.to_pylist()
            key = tuple(rows[0][k] for k in keys)
            pairs = sorted(((tuple(r[v] for v in vals), r[MULT]) for r in rows), key=lambda p: order_key(p[0]))
            out = [(*key, *made, m) for made, m in function(key, pairs)]
            kinds = to_arrow_schema(full)
            return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

        return self._to(self._totals().groupBy(*keys).applyInArrow(run, full), [f.name for f in schema])

    def threshold(self, function: Callable[[Column], Column]) -> Grouped:
        """Each value's multiplicity as a function of its total; zero removes it."""
        if self.flow.df.isStreaming:
            pairs = Flow(self.flow.df.select(*self._all, *self.flow._mult()), self.flow.stateful, self.flow.look_back)
            return Grouped(pairs.threshold(function), self.keys, self.vals)
        out = self._totals().withColumn(MULT, function(F.col(MULT)).cast("long")).filter(F.col(MULT) != 0)
        return self._to(out, self.vals)

    def distinct(self) -> Grouped:
        """Every value that is there once, whatever its total."""
        if self.flow.df.isStreaming:
            pairs = Flow(self.flow.df.select(*self._all, *self.flow._mult()), self.flow.stateful, self.flow.look_back)
            return Grouped(pairs.distinct(), self.keys, self.vals)
        if self.flow.insert_only:
            return self._to(self.flow.df.select(*self._all).distinct(), self.vals)
        return self._to(self._totals().drop(MULT), self.vals)

    def count(self, name: str = "n") -> Grouped:
        """The sum of a key's totals; zero where they cancel in a key that is there."""
        if self.flow.df.isStreaming:
            from sluice.streaming import counted

            pairs = Flow(self.flow.df.select(*self._all, *self.flow._mult()), self.flow.stateful, self.flow.look_back)
            return Grouped(counted(pairs, self.keys, name), self.keys, [name])
        total = F.count(F.lit(1)) if self.flow.insert_only else F.sum(MULT)
        return self._to(self._present().groupBy(*self.keys).agg(total.alias(name)), [name])

    def _extreme(self, pick, first: Column | None = None) -> Grouped:
        best = spare(self._all, "__best")
        out = self._present().groupBy(*self.keys).agg(pick(ordered(self.vals, first, spare(self.vals, "__first"))).alias(best))
        return self._to(out.select(*self.keys, *(F.col(best)[v].alias(v) for v in self.vals if v not in self.keys)), self.vals)

    def _stream_extreme(self, greatest: bool) -> Grouped:
        """What only grows keeps one value for each key, else all are kept."""
        if self.flow.insert_only:
            from sluice.streaming import extreme

            return Grouped(extreme(self, greatest), self.keys, self.vals)
        k = -1 if greatest else 0
        return self._streamed(lambda rows: [(rows[k][0], 1)], StructType(self._fields(*self.vals)), self.vals)

    def min(self) -> Grouped:
        """The smallest value of a key by the order of its columns."""
        if self.flow.df.isStreaming:
            return self._stream_extreme(False)
        return self._extreme(F.min)

    def max(self) -> Grouped:
        if self.flow.df.isStreaming:
            return self._stream_extreme(True)
        return self._extreme(F.max)

    def max_by(self, rank: Column) -> Grouped:
        """The value of the greatest rank; of several, the greatest value."""
        if self.flow.df.isStreaming:
            by = spare(self._all, "__rank")
            inner = Grouped(self.flow._with(self.flow.df.withColumn(by, rank)), self.keys, [by, *self.vals]).max()
            return Grouped(inner.flow._with(inner.flow.df.drop(by)), self.keys, self.vals)
        return self._extreme(F.max, rank)

    def ungroup(self) -> Flow:
        """The values."""
        return self.flow.map(*self.vals)

    def ungroup_with(self, *columns: Column | str) -> Flow:
        """Any expressions over keys and values."""
        return self.flow.map(*columns)

    def ungroup_both(self) -> Flow:
        """Keys and values."""
        return self.flow.map(*self._all)

    def regroup(self, keys: dict[str, Column], vals: dict[str, Column]) -> Grouped:
        """Groups the groups' rows again."""
        new = self.flow.map(*(c.alias(k) for k, c in keys.items()), *(c.alias(k) for k, c in vals.items()))
        return Grouped(new, list(keys), list(vals))

    def join(self, other: Grouped, items: Column, name: str, *keep: Column | str) -> Flow:
        """A row for each element of ``items`` of each pair of rows of a key; multiplicities multiply."""
        pairs = self._pairs(other)
        return pairs._with(pairs.df.select(*keep, F.explode(items).alias(name), *pairs._mult()))

    def join_single(self, other: Grouped, *columns: Column | str) -> Flow:
        """One row for each pair of rows of a key."""
        return self._pairs(other).map(*columns)

    def _pairs(self, other: Grouped) -> Flow:
        left, right = self.flow, other.flow
        stateful = True
        if left.df.isStreaming or right.df.isStreaming:
            from sluice.streaming import joined

            return joined(self, other)
        a, b = left.df.select(*self._all, *left._mult()), right.df.select(*other._all, *right._mult())
        if left.insert_only and right.insert_only:
            return Flow(a.join(b, self.keys), stateful, left.look_back)
        m = spare([*a.columns, *b.columns], "__other")
        out = weighted(a).join(weighted(b).withColumnRenamed(MULT, m), self.keys)
        return Flow(out.withColumn(MULT, F.col(MULT) * F.col(m)).drop(m), stateful, left.look_back)
