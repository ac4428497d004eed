"""The batch stepper: a query's deltas from one prefix of its input to the next.

A step's deltas are the query over all rows so far less the query over the rows before, consolidated.  This difference is
the specification that incremental execution must meet.  Where a query's results for a key depend on that key's input
alone, ``keys`` names the input columns, and a step evaluates only the keys that its batch touches.  A query whose results
add up over its input's rows, such as a join with a table that isn't fed, is ``linear``: a step evaluates its batch alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import MULT, Flow, consolidate, negate, spare, union, weighted
from sluice.sources import joint_look_back, route


class Machine:
    """A query of one or several input flows, fed batch by batch.

    look_back: of each input, where it has one; the machine's is none if any input has none, else the longest.
    linear: the query of several batches together is the sum of the query of each.
    """

    def __init__(self, query: Callable[..., Flow], keys: list[str] | None = None, look_back: str | None = None, inputs: int = 1, look_backs: Sequence[str | None] | None = None, linear: bool = False):
        self.linear = linear
        self.query, self.keys, self.n = query, keys, inputs
        self.look_back = joint_look_back(list(look_backs)) if look_backs else look_back
        self.before: list[DataFrame | None] = [None] * inputs
        self.batch: list[DataFrame | None] = [None] * inputs
        self.time = 0

    def feed(self, rows: DataFrame, to: int = 0) -> Machine:
        """Adds rows (with MULT or not) to the next step's batch of an input."""
        self.batch[to] = weighted(rows) if self.batch[to] is None else union([self.batch[to], weighted(rows)])
        return self

    def feed_first(self, events: DataFrame, decoders: Sequence[Column]) -> DataFrame:
        """Each event goes to the first input whose decoder takes it, as columns of the decoded struct; gives the others."""
        routed = route(events, list(decoders))
        for k, d in enumerate(decoders):
            name = spare(events.columns, "record")
            self.feed(routed.filter(F.col("route") == k + 1).select(d.alias(name)).select(f"{name}.*"), k)
        return routed.filter("route is null").drop("route")

    def needs_state(self, *samples: DataFrame) -> bool:
        """Whether a restart has to replay history."""
        return self.query(*map(Flow, samples)).stateful

    def drain(self) -> DataFrame:
        """The consolidated deltas of what was fed since the last step."""
        known = next((b for b in [*self.batch, *self.before] if b is not None), None)
        if known is None or all(b is None for b in self.batch):
            raise ValueError("nothing was fed")
        batch, before = self.batch, self.before
        after = [b if a is None else a if b is None else union([a, b]) for a, b in zip(before, batch, strict=True)]
        if any(a is None for a in after):
            raise ValueError("an input was never fed; feed it an empty table")
        if self.linear:
            # earlier rows are needed no more; an input that isn't fed is as an empty one
            rows = [a if b is None else b for a, b in zip(before, batch, strict=True)]
            self.before, self.batch, self.time = [r.limit(0) for r in rows], [None] * self.n, self.time + 1
            return consolidate(weighted(self.query(*map(Flow, rows)).df))
        self.before, self.batch, self.time = after, [None] * self.n, self.time + 1
        if self.keys:
            touched = union([b.select(*self.keys) for b in batch if b is not None]).distinct()
            after = [a.join(touched, self.keys, "left_semi") for a in after]
            before = [a if a is None else a.join(touched, self.keys, "left_semi") for a in before]
        now = weighted(self.query(*map(Flow, after)).df)
        if any(a is not None for a in before):
            empty = [a.limit(0) if b is None else b for a, b in zip(after, before, strict=True)]
            now = union([now, negate(self.query(*map(Flow, empty)).df)])
        return consolidate(now)

    def steps(self, rows: DataFrame, step: str, n: int) -> DataFrame:
        """All deltas of batches 0 to n - 1, told apart by a column of rows."""
        out = None
        for k in range(n):
            deltas = self.feed(rows.filter(F.col(step) == k).drop(step)).drain()
            out = deltas if out is None else union([out, deltas])
        return out


def assert_deltas(deltas: DataFrame, expected: list[tuple]) -> None:
    """Test helper: deltas in the order of the data, each row with its multiplicity last."""
    cols = [c for c in deltas.columns if c != MULT]
    got = [tuple(r) for r in deltas.orderBy(*cols).select(*cols, MULT).collect()]
    assert got == expected, f"{got} != {expected}"
