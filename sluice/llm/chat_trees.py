r"""Chat formatting as prefix trees: turns that conversations share at their start are emitted once.

A turn is a node.  Its formatted text is ``<|turn|>role\ntext<|end|>``; control strings inside a role or text get one
more backslash after their first sign (and lose one on the way back), so any text survives.  Its tokens are the control
tokens TURN, SEP and END, which no text can produce, around the byte-level BPE ids of role and text.

Conversations are sorted by their sequences of turn hashes (128 bits a turn), which is depth-first order, and dealt out
over shards by range.  Each shard is a stream of tokens of its own in which every distinct prefix stands once: so a
turn that very many conversations share is repeated once a shard, not gathered in one task.  A node carries its place in
the stream, its first position id (the tokens of its ancestors; ids rise by one within the node) and the intervals of
the stream that its tokens attend to besides its own earlier ones, namely its ancestors'.  The loss mask covers the text
of assistant turns, that is the tokens from body to body_end.

Tasks stream over sorted rows and hold one path of the tree.

Nulls: a null text or role is empty.  Rows of a conversation with equal turns are all kept, ordered by role and text;
a null turn comes first.  Rows without a conv_id form a conversation with a null id.  An empty table gives no rows.
A long text or conversation is handled like any other; a task holds its turns' hashes, and its texts to write its digest.
Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import scratch, token_files

TURN, SEP, END = 0, 1, 2
_TURN, _SEP, _END = (np.array([x], np.int32) for x in (TURN, SEP, END))
#: Rows that a task turns into Python objects at once.
ROWS = 4096
_control = re.compile(r"(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)")
_control_escaped = re.compile(r"(<|\[)\\(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)")
TREE = (
    "shard int, seq long, conv_id long, depth int, node long, parent long, start long, position long,"
    " tokens array<int>, body int, body_end int, loss boolean, attend array<struct<begin:long,end:long>>"
)


def escape(text: str) -> str:
    """text with its control strings broken."""
    return _control.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    """Undoes escape."""
    return _control_escaped.sub(r"\1\2\3", text)


def formatted(role: str, text: str) -> str:
    """A turn as it is formatted."""
    return f"<|turn|>{escape_role(role)}\n{escape(text)}<|end|>"


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    """Undoes escape_role."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _keys(batches):
    """(conv_id, key): for each conversation, rows of which come in order, the bytes of its turns' hashes."""
    conv, parts = None, []
    for b in batches:
        ids, keys = [], []
        for c, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if parts and c != conv:
                ids.append(conv)
                keys.append(b"".join(parts))
                parts = []
            conv = c
            parts.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["conv_id", "key"])
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["conv_id", "key"])


_KINDS = {
    "shard": pa.int32(), "seq": pa.int64(), "conv_id": pa.int64(), "depth": pa.int32(), "node": pa.int64(), "parent": pa.int64(), "start": pa.int64(), "position": pa.int64(),
    "tokens": pa.list_(pa.int32()), "body": pa.int32(), "body_end": pa.int32(), "loss": pa.bool_(), "attend": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
}


class _Walk:
    """The walk over one task's sorted rows; it holds the path of the tree on which it stands.

    stack: for each node of the path its hash, number, end, the position after it, and the stream's intervals that the
    path covers down to it, joined where they touch.
    """

    def __init__(self, path: str):
        self.path, self.roles = path, {}
        self.shard = self.held = self.conv = None
        self.at = self.seq = self.nodes = self.depth = 0
        self.stack: list[tuple] = []

    def _leaf(self, out: list) -> None:
        if self.depth:
            out.append((self.seq, self.conv, self.depth, None, self.stack[self.depth - 1][1], None, None, None, False, []))
            self.seq += 1

    def role(self, role: str) -> np.ndarray:
        """Ids of a role; roles are few, and the memo starts afresh where they aren't."""
        if role not in self.roles:
            if len(self.roles) > 4096:
                self.roles.clear()
            self.roles[role] = next(token_files.encoder(self.path).encode([escape_role(role)])).astype(np.int32) + 3
        return self.roles[role]

    def rows(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shards, places, convs, hashes, roles, texts = (c.to_pylist() for c in b.columns)
        # which rows are new nodes depends on hashes alone, so only their texts are encoded
        depth, top, held, new = self.depth, [x[0] for x in self.stack], self.held, []
        for k, h in enumerate(hashes):
            if (shards[k], places[k]) != held:
                top = top if held and held[0] == shards[k] else []
                held, depth = (shards[k], places[k]), 0
            if depth == len(top) or top[depth] != h:
                del top[depth:]
                top.append(h)
                new.append(k)
            depth += 1
        bodies = token_files.encoder(self.path).encode([escape(texts[k] or "") for k in new])
        out, parts, mark = [], [], set(new)
        for k, h in enumerate(hashes):
            if (shards[k], places[k]) != self.held:
                self._leaf(out)
                if shards[k] != self.shard:
                    if out:
                        yield self._batch(out, parts)
                    out, parts = [], []
                    self.shard, self.at, self.seq, self.nodes, self.stack = shards[k], 0, 0, 0, []
                self.held, self.depth = (shards[k], places[k]), 0
            self.conv = convs[k]
            if k in mark:
                del self.stack[self.depth :]
                _, parent, _, first, spans = self.stack[-1] if self.stack else (None, None, 0, 0, ())
                head, body = self.role(roles[k] or ""), next(bodies).astype(np.int32) + 3
                parts += [_TURN, head, _SEP, body, _END]
                n = len(head) + len(body) + 3
                out.append((self.seq, None, self.depth, (self.at, first, len(head) + 2, n), self.nodes, parent, None, None, roles[k] == "assistant", spans))
                own = (*spans[:-1], (spans[-1][0], self.at + n)) if spans and spans[-1][1] == self.at else (*spans, (self.at, self.at + n))
                self.stack.append((h, self.nodes, self.at + n, first + n, own))
                self.seq, self.nodes, self.at = self.seq + 1, self.nodes + 1, self.at + n
            self.depth += 1
        if out:
            yield self._batch(out, parts)

    def end(self) -> Iterator[pa.RecordBatch]:
        out: list = []
        self._leaf(out)
        if out:
            yield self._batch(out, [])

    def _batch(self, out: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        """The rows as Arrow: tokens and intervals are flat arrays under offsets."""
        seq, conv, depth, place, node, parent, _, _, loss, spans = zip(*out, strict=True)
        is_node = np.array([x is not None for x in place])
        ints = np.array([x or (0, 0, 0, 0) for x in place], np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        edges = np.array([y for x in spans for y in x], np.int64).reshape(-1, 2)
        offsets = lambda n, some: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(~some, False))
        pairs = pa.StructArray.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["begin", "end"])
        col = lambda x, kind: pa.array(x, kind, mask=~is_node)
        made = {
            "shard": pa.array(np.full(len(out), self.shard), pa.int32()), "seq": pa.array(seq, pa.int64()), "conv_id": pa.array(conv, pa.int64()), "depth": pa.array(depth, pa.int32()),
            "node": pa.array(node, pa.int64()), "parent": pa.array(parent, pa.int64()), "start": col(ints[:, 0], pa.int64()), "position": col(ints[:, 1], pa.int64()),
            "tokens": pa.ListArray.from_arrays(offsets(ints[:, 3], is_node), pa.array(flat)), "body": col(ints[:, 2].astype(np.int32), pa.int32()), "body_end": col((ints[:, 3] - 1).astype(np.int32), pa.int32()),
            "loss": col(np.array(loss), pa.bool_()), "attend": pa.ListArray.from_arrays(offsets(np.array([len(x) for x in spans]), is_node), pairs),
        }
        return pa.RecordBatch.from_arrays([made[k].cast(t) for k, t in _KINDS.items()], list(_KINDS))


def _emit(path: str):
    """Rows of the trees: a node's row where it first stands, a conversation's row (without tokens) after its last turn."""

    def run(batches):
        walk = _Walk(path)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                yield from walk.rows(b.slice(i, ROWS))
        yield from walk.end()

    return run


def build(rows: DataFrame, path: str) -> DataFrame:
    """The trees of conversations (conv_id, turn, role, text), written to the shared folder; columns as in TREE."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    role = F.coalesce("role", F.lit(""))
    # the role's length comes first, so that no sign of a role or text can move the border between them
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, F.col("text")), 256), 1, 32))
    rows = rows.withColumn("h", digest)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    hashes = rows.select("conv_id", "h", "turn", "role", "text").repartition(parts, "conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "h")
    keys = scratch.map_arrow(hashes, _keys, "conv_id long, key binary")
    placed = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    placed = scratch.materialize(placed.select("conv_id", F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("place")), "places")
    joined = rows.alias("r").join(placed.alias("p"), F.expr("r.conv_id <=> p.conv_id")).select("p.shard", "p.place", "r.conv_id", "r.turn", "r.role", "r.text", "r.h")
    dealt = joined.repartitionById(parts, "shard").sortWithinPartitions("shard", "place", *order).select("shard", "place", "conv_id", "h", "role", "text")
    return scratch.materialize(scratch.map_arrow(dealt, _emit(path), TREE), "trees")


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(path: str):
    def run(batches):
        decode = token_files.decoder(path).decode
        stack: list[tuple] = []  # (node, role, text, loss, formatted length)
        shard = None
        for b in batches:
            out = []
            shards, convs, depths, nodes, parents, bodies, ends, masked = (b.column(k).to_pylist() for k in ("shard", "conv_id", "depth", "node", "parent", "body", "body_end", "loss"))
            lists = b.column("tokens")
            flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, body in enumerate(bodies):
                if shards[k] != shard:
                    shard, stack = shards[k], []
                if body is not None:
                    ids = flat[bounds[k] : bounds[k + 1]]
                    if ids[0] != TURN or ids[body - 1] != SEP or ids[ends[k]] != END:
                        raise ValueError("a turn's control tokens aren't where they should be")
                    head, text = decode(ids[1 : body - 1] - 3), decode(ids[body : ends[k]] - 3)
                    del stack[depths[k] :]
                    if (stack[-1][0] if stack else None) != parents[k]:
                        raise ValueError("a node doesn't follow its parent")
                    size = len(f"<|turn|>{head}\n{text}<|end|>")
                    stack.append((nodes[k], unescape_role(head), unescape(text), masked[k], size))
                    continue
                turns, loss, n_loss, n_all = hashlib.sha256(), hashlib.sha256(), 0, 0
                for _, role, text, asked, size in stack[: depths[k]]:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n_all += size
                    if asked:
                        loss.update(text.encode("utf-8", "surrogatepass"))
                        n_loss += len(text)
                out.append((convs[k], depths[k], turns.hexdigest(), n_loss, loss.hexdigest(), n_all))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def read(tree: DataFrame, path: str) -> DataFrame:
    """What each conversation says, decoded from its path through the tree."""
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tree.select("shard", "seq", "conv_id", "depth", "node", "parent", "tokens", "body", "body_end", "loss")
    return scratch.map_arrow(rows.repartitionById(parts, "shard").sortWithinPartitions("shard", "seq"), _read(path), SCHEMA)


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read(build(scratch.union(rows, probe), path), path)


_SQL_ESCAPE = r"regexp_replace({}, '(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')"
OP1_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
), f as (
  select *, {_SQL_ESCAPE.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} as er, {_SQL_ESCAPE.format("text")} as et from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(er) + length(et) + 16) as bigint) as formatted_chars
from f group by conv_id
"""
