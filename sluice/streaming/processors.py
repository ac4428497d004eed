"""Keyed processors behind the stateful verbs.

Each loads its keys' state, applies all rows of the micro-batch, and then emits the difference to what it last gave: old
rows with multiplicity -1, new ones with +1.  State lives in the session's state store (RocksDB) and is restored from the
checkpoint.  A call to the store takes longer than the work on a key, so keys are dealt over pages by their hash, and a page
is one value of the store that is read and written once in a micro-batch.  Where a reduction's state can be small it is:
counts keep a total and a fingerprint, extremes of what only grows the value.
"""

from __future__ import annotations

import hashlib
import io
import pickle
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, LongType, MapType, StructField, StructType, VariantType

from sluice.functions.ordering import order_key
from sluice.operators.flow import Flow, Grouped
from sluice.operators.weights import MULT, spare, union, weighted

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pages that the keys of a verb are dealt over.  It is part of the state: another number needs a new checkpoint.
PAGES = 1 << 14
_PAGE = StructType([StructField("page", BinaryType())])


def use_rocksdb(spark) -> None:
    """The state store that the processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _Nan(float):
    """The one NaN: it stays the same object when it is unpickled, so it can be found in a dict."""

    def __reduce__(self):
        return "_NAN"


_NAN = _Nan("nan")


def _canonical(v):
    """Equal values as equal objects: one zero, one NaN, nested rows as tuples."""
    if isinstance(v, float):
        return _NAN if v != v else v + 0.0
    if isinstance(v, tuple | list):
        return tuple(map(_canonical, v))
    if isinstance(v, dict):
        return tuple(sorted((_canonical(k), _canonical(x)) for k, x in v.items()))
    return bytes(v) if isinstance(v, bytearray) else v


def _exact(kind: DataType) -> bool:
    """Whether all values of a type are canonical as they come."""
    return not isinstance(kind, DoubleType | FloatType | StructType | ArrayType | MapType | VariantType)


def _pack(values) -> tuple[bytes]:
    """Bytes of a tuple.  Without the pickler's memo they don't depend on which strings are the same object."""
    out = io.BytesIO()
    pickler = pickle.Pickler(out, protocol=4)
    pickler.fast = True
    pickler.dump(tuple(map(_canonical, values)))
    return (out.getvalue(),)


def _add(totals: dict[tuple, int], v: tuple, m: int) -> None:
    """Adds to a value's total, in place; a total of zero is left out."""
    n = totals.get(v, 0) + m
    if n:
        totals[v] = n
    else:
        totals.pop(v, None)


def _greater(a: tuple, b: tuple) -> bool:
    try:
        return a > b
    except TypeError:  # None has a place in our order only
        return order_key(a) > order_key(b)


def _in_order(pairs) -> list[tuple[tuple, int]]:
    try:
        return sorted(pairs, key=itemgetter(0))
    except TypeError:
        return sorted(pairs, key=lambda p: order_key(p[0]))


def _difference(old: dict[tuple, int], new: dict[tuple, int]) -> list[tuple[tuple, int]]:
    if old == new:
        return []
    return [(v, m) for v in {**old, **new} if (m := new.get(v, 0) - old.get(v, 0))]


def _replaced(old: tuple | None, new: tuple | None) -> list[tuple[tuple, int]]:
    return [(v, m) for v, m in ((old, -1), (new, 1)) if v is not None]


def _picker(at: list[int]):
    """Some places of a tuple, as a tuple."""
    return itemgetter(*at) if len(at) > 1 else (lambda t, i=at[0]: (t[i],)) if at else lambda t: ()


class _Out(dict):
    """A row as Spark's writer of results asks for it."""

    def asDict(self, recursive: bool = False) -> dict:
        return self


class _Processor(StatefulProcessor):
    """A key's state is None at first.  begin(state) makes what add(work, value, multiplicity) changes for each row;
    end(key, state, work) gives the new state, None for none and the same object if it didn't change, and the output rows
    with their multiplicities."""

    keys: list[str]
    vals: list[str]
    names: list[str]
    exact = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", _PAGE)
        self.picks = None

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[_Out]:
        found = self.page.get() if self.page.exists() else None
        page = pickle.loads(bytes(found[0])) if found else {}
        work: dict[tuple, object] = {}
        exact, begin, add = self.exact, self.begin, self.add
        for r in rows:
            if self.picks is None:
                at = {c: i for i, c in enumerate(r.__fields__)}
                self.picks = _picker([at[k] for k in self.keys]), _picker([at[v] for v in self.vals]), at[MULT]
            of_key, of_value, of_mult = self.picks
            r = tuple(r)
            k, v = of_key(r), of_value(r)
            if not exact:
                k, v = _canonical(k), _canonical(v)
            w = work.get(k, work)
            if w is work:
                w = work[k] = begin(page.get(k))
            add(w, v, r[of_mult])
        out, changed = [], False
        for k, w in work.items():
            old = page.get(k)
            new, moves = self.end(k, old, w)
            if new is None:
                page.pop(k, None)
            else:
                page[k] = new
            changed = changed or new is not old
            out += self.rows(k, moves)
        work.clear()
        if changed and page:
            self.page.update((pickle.dumps(page, 5),))
        elif changed and found:
            self.page.clear()
        names = [*self.names, MULT]
        for row in out:
            yield _Out(zip(names, row, strict=True))

    def rows(self, key: tuple, moves) -> list[tuple]:
        """Output rows of a key."""
        return [(*key, *v, m) for v, m in moves]


class Reduce(_Processor):
    """A function of a key's values, [(value, total)] in order, to rows with multiplicities."""

    def __init__(self, function, keys: list[str], vals: list[str], names: list[str], takes_key: bool, head: list[str]):
        """head: the keys before the function's own columns."""
        self.function, self.keys, self.vals, self.names, self.takes_key = function, keys, vals, names, takes_key
        self.head = _picker([keys.index(k) for k in head])

    def begin(self, state):
        return state[0] if state else {}

    def add(self, work, v, m):
        _add(work, v, m)

    def end(self, key, state, values):
        made: dict[tuple, int] = {}
        if values:
            pairs = _in_order(values.items())
            for v, m in self.function(pairs, key) if self.takes_key else self.function(pairs):
                _add(made, _canonical(tuple(v)), m)
        return (values, made) if values or made else None, _difference(state[1] if state else {}, made)

    def rows(self, key, moves):
        return super().rows(self.head(key), moves)


class Present(_Processor):
    """Each key once, while its total isn't zero."""

    def __init__(self, keys: list[str]):
        self.keys, self.vals, self.names = keys, [], keys

    def begin(self, state):
        return [state or 0]

    def add(self, work, v, m):
        work[0] += m

    def end(self, key, state, work):
        new = work[0] or None
        return new, [((), (new is not None) - (state is not None))] if (new is None) != (state is None) else []


class Count(_Processor):
    """The sum of a key's totals, for a key that has values; of a whole element, where its total isn't zero.

    State is the sum and, as values may cancel, the sum of their digests times their totals, which is 0 modulo 2^128 just
    if no value is left (but for a chance of 2^-128).  What only grows needs no digests, nor does a whole element: there the
    sum itself tells.
    """

    def __init__(self, keys: list[str], vals: list[str], name: str):
        self.keys, self.vals, self.names = keys, vals, [*keys, name]

    def begin(self, state):
        return list(state or (0, 0))

    def add(self, work, v, m):
        work[0] += m
        if v:
            work[1] += m * int.from_bytes(hashlib.blake2b(_pack(v)[0], digest_size=16).digest())

    def end(self, key, state, work):
        total, print_ = work[0], work[1] % (1 << 128) if self.vals else work[0]
        new = (total, print_) if print_ else None
        if new == state:
            return state, []
        old = state[0] if state else None
        now = total if print_ else None
        return new, [((n,), m) for n, m in ((old, -1), (now, 1)) if n is not None] if now != old else []


class Extreme(_Processor):
    """The greatest or smallest value of a key of a flow that only grows."""

    def __init__(self, keys: list[str], vals: list[str], greatest: bool):
        self.keys, self.vals, self.greatest = keys, vals, greatest
        self.own = [i for i, v in enumerate(vals) if v not in keys]
        self.names = [*keys, *(vals[i] for i in self.own)]

    def begin(self, state):
        return [state]

    def add(self, work, v, m):
        best = work[0]
        if best is None or (_greater(v, best) if self.greatest else _greater(best, v)):
            work[0] = v

    def end(self, key, state, work):
        best = work[0]
        return best, [] if best is state else _replaced(state, best)

    def rows(self, key, moves):
        return [(*key, *(v[i] for i in self.own), m) for v, m in moves]


class FirstAndSum(_Processor):
    """The first name of a key of a flow that only grows, by an order before it, and the sum of its pieces; values are
    (order..., name, pieces)."""

    def __init__(self, keys: list[str], vals: list[str], names: list[str]):
        self.keys, self.vals, self.names = keys, vals, names

    def begin(self, state):
        return list(state or (None, None))

    def add(self, work, v, m):
        *first, pieces = v
        first = tuple(first)
        if work[0] is None or _greater(work[0], first):
            work[0] = first
        if pieces is not None:
            work[1] = (work[1] or 0) + m * pieces

    def end(self, key, state, work):
        shown = lambda s: s and (s[0][-1], None if s[1] is None else int(s[1]))
        new = tuple(work)
        if new == state:
            return state, []
        return new, _replaced(shown(state), shown(new)) if shown(state) != shown(new) else []


class _OfRows(_Processor):
    """Rows that hold their key: values are whole rows and the output has no key before them."""

    def rows(self, key, moves):
        return [(*v, m) for v, m in moves]


class MonotonicMax(_OfRows):
    """The greatest row of a key; taking back what is the greatest at the end of a batch is an error."""

    def __init__(self, keys: list[str], columns: list[str]):
        self.keys, self.vals, self.names = keys, columns, columns

    def begin(self, state):
        return [state, set()]

    def add(self, work, v, m):
        best, gone = work
        if m < 0:
            gone.add(v)
        if best is None or _greater(v, best):
            work[0] = v

    def end(self, key, state, work):
        best, gone = work
        if best in gone:
            raise ValueError(f"key {key}: the greatest row {best} was taken back")
        return best, [] if best is state else _replaced(state, best)


class Representative(_OfRows):
    """The first row of a key, kept for good; an error once it has been taken back as often as it came."""

    def __init__(self, keys: list[str], columns: list[str], order_by: list[str]):
        self.keys, self.vals, self.names = keys, columns, columns
        order = [*order_by, *(c for c in columns if c not in order_by)]
        self.order = _picker([columns.index(c) for c in order])

    def begin(self, state):
        return []

    def add(self, work, v, m):
        work.append((v, m))

    def end(self, key, state, work):
        kept, total = state or (None, 0)
        for v, m in sorted(work, key=lambda p: order_key(self.order(p[0]))):
            if kept is None:
                kept, total = v, 1
            elif v == kept:
                total += m
                if total <= 0:
                    raise ValueError(f"key {key}: the representative {v} was taken back")
        new = (kept, total)
        return state if new == state else new, [] if state else [(kept, 1)]


class Join(_Processor):
    """Inner join of two tagged inputs: each side's totals are kept, and a batch gives what its changes pair with."""

    def __init__(self, keys: list[str], left: list[str], right: list[str]):
        self.keys, self.n, self.names = keys, len(left), [*keys, *left, *right]
        self.vals = ["__side", *(f"__l{i}" for i in range(len(left))), *(f"__r{i}" for i in range(len(right)))]

    def begin(self, state):
        return {}, {}

    def add(self, work, v, m):
        _add(work[v[0]], v[self.n + 1 :] if v[0] else v[1 : self.n + 1], m)

    def end(self, key, state, work):
        left, right = state or ({}, {})
        out: dict[tuple, int] = {}
        for b, n in work[1].items():
            for a, m in left.items():
                _add(out, a + b, m * n)
            _add(right, b, n)
        for a, m in work[0].items():
            for b, n in right.items():
                _add(out, a + b, m * n)
            _add(left, a, m)
        return (left, right) if left or right else None, out.items()


def _schema(fields) -> StructType:
    return StructType([*fields, StructField(MULT, LongType())])


def _run(df: DataFrame, keys: list[str], processor: _Processor, schema: StructType) -> DataFrame:
    df = weighted(df)
    page = spare(df.columns, "__page")
    needed = list(dict.fromkeys([*processor.keys, *processor.vals]))
    processor.exact = all(_exact(df.schema[c].dataType) for c in needed)
    at = (F.pmod(F.xxhash64(*keys), F.lit(PAGES)) if keys else F.lit(0)).cast("int").alias(page)
    return df.select(at, *needed, MULT).groupBy(page).transformWithState(processor, schema, "Update", "None")


def reduced(flow: Flow, keys: list[str], function, schema: StructType, vals: list[str] | None = None, whole: bool = False) -> Flow:
    """The flow's keyed reduction.  function(pairs) or function(pairs, key) gives rows of ``schema`` (with ``whole``, the
    output rows themselves; else they follow the key's columns)."""
    import inspect

    df = weighted(flow.df)
    vals = vals if vals is not None else flow.columns
    # a value that is a key is known; output columns are told apart by name
    own = [] if whole else [df.schema[k] for k in keys if k not in schema.names]
    names = [f.name for f in own] + schema.names
    takes_key = len(inspect.signature(function).parameters) == 2
    processor = Reduce(function, keys, vals, names, takes_key, [f.name for f in own])
    return Flow(_run(df, keys, processor, _schema([*own, *schema.fields])), True, flow.look_back)


def present(flow: Flow) -> Flow:
    """Each element whose total isn't zero, once."""
    df, keys = weighted(flow.df), flow.columns
    return Flow(_run(df, keys, Present(keys), _schema(df.schema[k] for k in keys)), True, flow.look_back)


def counted(flow: Flow, keys: list[str], name: str, of_rows: bool = True) -> Flow:
    """Counts by key; ``of_rows``: a key counts while it has rows, else while its total isn't zero."""
    df = weighted(flow.df)
    vals = [c for c in flow.columns if c not in keys] if of_rows and not flow.insert_only else []
    return Flow(_run(df, keys, Count(keys, vals, name), _schema([*(df.schema[k] for k in keys), StructField(name, LongType())])), True, flow.look_back)


def extreme(grouped: Grouped, greatest: bool) -> Flow:
    df = grouped.flow.df.select(*grouped._all)
    return Flow(_run(df, grouped.keys, Extreme(grouped.keys, grouped.vals, greatest), _schema(df.schema[c] for c in grouped._all)), True, grouped.flow.look_back)


def first_and_sum(flow: Flow, keys: list[str], order_by: list[str], name: str, pieces: str, total: str) -> Flow:
    """(keys, the first row's name, the sum of pieces) of a flow that only grows."""
    if not flow.insert_only:
        raise ValueError("rows that may be taken back need all values; use reduce_rows")
    df = weighted(flow.df)
    own = [df.schema[c] for c in (*keys, name)] + [StructField(total, LongType())]
    return Flow(_run(df, keys, FirstAndSum(keys, [*order_by, name, pieces], [f.name for f in own]), _schema(own)), True, flow.look_back)


def monotonic_max(flow: Flow, keys: list[str]) -> Flow:
    df = weighted(flow.df)
    fields = [df.schema[c] for c in flow.columns]
    return Flow(_run(df, keys, MonotonicMax(keys, flow.columns), _schema(fields)), True, flow.look_back)


def representative(flow: Flow, keys: list[str], order_by: list[str]) -> Flow:
    df = weighted(flow.df)
    fields = [df.schema[c] for c in flow.columns]
    return Flow(_run(df, keys, Representative(keys, flow.columns, order_by), _schema(fields)), True, flow.look_back)


def joined(left: Grouped, right: Grouped) -> Flow:
    """(keys, left values, right values) of two keyed streams."""
    if left.keys != right.keys:
        raise ValueError(f"different keys: {left.keys} and {right.keys}")
    keys = left.keys
    a, b = weighted(left.flow.df), weighted(right.flow.df)
    av, bv = ([v for v in g.vals if v not in keys] for g in (left, right))
    fields = [[a.schema[v] for v in av], [b.schema[v] for v in bv]]
    sides = []
    for s, (df, own) in enumerate(((a, av), (b, bv))):
        cols = [F.lit(s).alias("__side")]
        for t, prefix in ((0, "__l"), (1, "__r")):
            for i, f in enumerate(fields[t]):
                cols.append((F.col(own[i]) if t == s else F.lit(None).cast(f.dataType)).alias(f"{prefix}{i}"))
        sides.append(df.select(*keys, *cols, MULT))
    schema = _schema([*(a.schema[k] for k in keys), *fields[0], *fields[1]])
    return Flow(_run(union(sides), keys, Join(keys, av, bv), schema), True, left.flow.look_back)


__all__ = ["STATE_STORE", "Count", "Extreme", "FirstAndSum", "Join", "MonotonicMax", "Present", "Reduce", "Representative", "counted", "extreme", "first_and_sum", "joined", "monotonic_max", "present", "reduced", "representative", "use_rocksdb"]
