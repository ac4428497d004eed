"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Every id is replaced by its rank among all ids by descending corpus frequency, so that common ids take one byte.  A file
holds blocks of whole documents; a block is

    u32 documents, u32 ids | i64 doc_id per document | u32 ids per document | control bytes | data bytes

with two control bits per id (its length in bytes less one; four ids to a control byte, the first in the low bits) and
1 to 4 little-endian data bytes.  A decoder looks all four lengths up by control byte and gathers data with numpy.
``ranks.u32`` beside the files lists the ids by rank.

Ranks are known only when all texts are encoded, so the ids first go to a plain file for each partition (blocks as above
with the ids themselves in place of control and data bytes), counted on the way; each is then rewritten by rank and
removed.  Texts are encoded once, and at most one form of a partition is kept.

Nulls: a null text is the empty text, which gives the end id alone.  A null doc_id sorts first and comes back null.
Repeated rows: each is written.  An empty table gives no file but ranks.u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import kernels as K
from sluice.llm import scratch

#: Ids in a block, about.
BLOCK_IDS = 1 << 17
#: Distinct pre-tokens that a worker keeps.
MEMO = 3_000_000
#: Stands for a null doc_id in a file.
NO_ID = -(1 << 63)

_LENS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    lens = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = lens - 1
    q = codes.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    keep = np.arange(4) < lens[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values behind control and data bytes."""
    lens = _LENS[control].reshape(-1)[:n]
    ends = np.cumsum(lens, dtype=np.int64)
    at = ends - lens
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(lens > k)
        out[long] |= padded[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def data_bytes(control: np.ndarray, n: int) -> int:
    return int(_LENS[control].reshape(-1)[:n].sum(dtype=np.int64))


def blocks(docs: Iterable[tuple[int | None, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document, ids) of whole documents, in the order given; each has a (doc_id, ids)."""
    held: list[tuple[int | None, np.ndarray]] = []
    total = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.array([NO_ID if d is None else d for d, _ in held], "<i8")
        sizes = np.array([len(x) for _, x in held], "<u4")
        return keys, sizes, np.concatenate([x for _, x in held])

    for d, x in docs:
        held.append((d, x))
        total += len(x)
        if total >= BLOCK_IDS:
            yield flush()
            held, total = [], 0
    if held:
        yield flush()


def _head(keys: np.ndarray, sizes: np.ndarray, n: int) -> bytes:
    return struct.pack("<II", len(keys), n) + keys.tobytes() + sizes.tobytes()


def _heads(file) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """doc_ids, ids per document and number of ids of each block; the caller reads what follows before the next."""
    while head := file.read(8):
        n_docs, n = struct.unpack("<II", head)
        yield np.frombuffer(file.read(8 * n_docs), "<i8"), np.frombuffer(file.read(4 * n_docs), "<u4"), n


def read_blocks(file, by_rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document, ids) of each block."""
    for keys, sizes, n in _heads(file):
        control = np.frombuffer(file.read(-(-n // 4)), np.uint8)
        data = np.frombuffer(file.read(data_bytes(control, n)), np.uint8)
        yield keys, sizes.astype(np.int64), by_rank[unpack(control, data, n)]


def finish(plain: str, rank: np.ndarray) -> str:
    """Rewrites a plain file (its suffix is the ids' type) by rank and removes it; gives the new file's name.

    The new file is whole before the plain one goes, so a task that is tried again finds one of them.
    """
    stem, kind = plain.rsplit(".", 1)
    name, dtype = f"{stem}.tok", np.dtype(f"<{kind}")
    if scratch.exists(plain) or not scratch.exists(name):
        with scratch.open_file(plain) as f:
            ids = ((k, s, np.frombuffer(f.read(n * dtype.itemsize), dtype)) for k, s, n in _heads(f))
            scratch.write_file(name, (_head(k, s, len(x)) + b"".join(pack(rank[x])) for k, s, x in ids))
        scratch.drop_file(plain)
    return name


# --- encoding ---------------------------------------------------------------------------------------------------------

_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """By code point: 0 other, 1 white space, 2 letter, 3 number."""
    global _kinds
    if _kinds is None:
        import unicodedata

        table = np.zeros(0x110000, np.uint8)
        cat = unicodedata.category
        major = np.array([ord(cat(chr(c))[0]) for c in range(0x30000)], np.uint8)
        table[:0x30000][major == ord("L")] = 2
        table[:0x30000][major == ord("N")] = 3
        for c in range(0x30000, 0x33480):
            table[c] = {"L": 2, "N": 3}.get(cat(chr(c))[0], 0)
        table[_SPACE] = 1
        _kinds = table
    return _kinds


def cut(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of byte-level BPE: contractions, an optional space with letters, with numbers or
    with other signs, and white space up to its last character before something else."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds()[codes]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= edge[:-1]
    start = new.copy()
    follows = np.flatnonzero(new[1:] & (kind[1:] != 1) & (kind[:-1] == 1) & ~edge[1:-1]) + 1
    start[follows - 1] = True
    start[follows[codes[follows - 1] == 0x20]] = False
    for i in np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kind[1:] == 2) & ~edge[1:-1]).tolist():
        a, b = int(codes[i + 1]), int(codes[i + 2]) if i + 2 < n and not edge[i + 2] else 0
        size = 1 if chr(a) in "stmd" else 2 if (chr(a), chr(b)) in (("r", "e"), ("v", "e"), ("l", "l")) else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < n and not edge[i + 1 + size] and kind[i + 1 + size] == 2:
                start[i + 1 + size] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


class Encoder:
    """Byte-level BPE of whole texts with the tokenizers library, once for each distinct pre-token of a worker.

    The merges never cross a pre-token, so a text's ids are those of its pre-tokens in a row.  Texts that hold one of the
    tokenizer's added tokens go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.store = K.SegmentStore(self.dtype, MEMO)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for a, b in K.slices(texts):
            part = texts[a:b]
            classes, at, starts, bounds = self._segments(part)
            each = at[classes]
            lens = self.store.size[each]
            flat = self.store.flat[K.gather_ranges(self.store.start[each], lens)]
            ends = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, bounds)]
            out = [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            for k in self._special(part):
                out[k] = self._whole(part[k])
            yield from out

    def _special(self, texts: list[str | None]) -> list[int]:
        return [k for k, t in enumerate(texts) if t and any(x in t for x in self.added)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _segments(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each pre-token its class, for each class its place in the memo; the pre-tokens' starts, the texts' bounds."""
        self.store.trim()
        joined, codes, bounds = K.flat_codes(texts)
        starts, ends = cut(codes, bounds)
        classes, hashes, first = K.distinct(K.segment_hashes(codes, starts, ends))
        at = self.store.find(hashes)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            where = first[lacking]
            words = [joined[i:j] for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for i in ids for x in i), self.dtype, int(lens.sum()))
            at[lacking] = self.store.add(hashes[lacking], flat, lens)
        return classes, at, starts, bounds


class Decoder:
    """Byte-level BPE ids back to text: a table of each id's bytes, gathered with numpy."""

    def __init__(self, tokenizer):
        # signs that stand for bytes: printable ones for themselves, the others from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        whole = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        table = [b""] * tokenizer.get_vocab_size()
        for piece, i in tokenizer.get_vocab().items():
            table[i] = whole[i] if i in whole else bytes(byte[c] for c in piece)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(x) for x in table], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> str:
        return self.flat[K.gather_ranges(self.at[ids], self.size[ids])].tobytes().decode("utf-8", "surrogatepass")


_encoders: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; its memo of pre-tokens outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decoder(path: str) -> Decoder:
    """The worker's decoder."""
    if path not in _decoders:
        from tokenizers import Tokenizer

        _decoders[path] = Decoder(Tokenizer.from_file(path))
    return _decoders[path]


def write(docs: DataFrame, path: str, out: str, end_id: int = 0) -> list[tuple[str, int, int]]:
    """Encode docs (doc_id, text) and write the files under ``out`` in ascending doc_id order.

    Gives (file, documents, ids) of each file in order.  One shuffle of texts: a range partitioning by doc_id.  What
    reaches the driver is bounded by the vocabulary and the number of files.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("file", pa.string()), ("id", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])

    def save(batches):
        enc, docs_seen = encoder(path), 0
        total = np.zeros(max(enc.tokenizer.get_vocab_size(), end_id + 1), np.int64)

        def rows():
            end = np.array([end_id], enc.dtype)
            for b in batches:
                for d, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                    yield d, np.concatenate([ids, end])

        def plain():
            nonlocal total, docs_seen
            for keys, sizes, ids in blocks(rows()):
                total += np.bincount(ids, minlength=len(total))
                docs_seen += len(keys)
                yield _head(keys, sizes, len(ids)) + ids.astype(ids.dtype.newbyteorder("<"), copy=False).tobytes()

        name = f"{out}/part-{TaskContext.get().partitionId():06d}.{np.dtype(enc.dtype).str[1:]}"
        first = next(it := plain(), None)
        if first is not None:
            scratch.write_file(name, _chain(first, it))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"file": [name], "id": [None], "docs": [docs_seen], "n": [int(total.sum())]}, schema)
            nothing = pa.nulls(len(seen), pa.string())
            yield pa.RecordBatch.from_pydict({"file": nothing, "id": seen, "docs": np.zeros_like(seen), "n": total[seen]}, schema)

    parts = docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first())
    saved = scratch.map_arrow(parts.sortWithinPartitions(F.col("doc_id").asc_nulls_first()), save, "file string, id long, docs long, n long")
    found = saved.groupBy("file", "id").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).collect()
    files = sorted((r.file, r.docs, r.n) for r in found if r.file is not None)
    times = {r.id: r.n for r in found if r.file is None}

    n = np.zeros(max([end_id, *times]) + 1, np.int64)
    n[list(times)] = list(times.values())
    by_rank = np.argsort(-n, kind="stable").astype(np.uint32)
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    scratch.write_file(f"{out}/ranks.u32", [by_rank.astype("<u4").tobytes()])
    if not files:
        return []
    shared = spark.sparkContext.broadcast(rank)  # 4 bytes for each id of the vocabulary
    names = [f for f, _, _ in files]

    def rewrite(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"k": [k], "file": [finish(names[k], shared.value)]})

    done = scratch.map_arrow(spark.range(0, len(files), 1, len(files)), rewrite, "k long, file string").collect()
    final = {r.k: r.file for r in done}
    return [(final[k], d, ids) for k, (_, d, ids) in enumerate(files)]


def _chain(first, rest):
    yield first
    yield from rest


def read(spark: SparkSession, out: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files; ``files`` as write() gives it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    before, jobs = 0, []
    for name, _, ids in files:
        jobs.append((name, before))
        before += ids

    def load(batches):
        with scratch.open_file(f"{out}/ranks.u32") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with scratch.open_file(name) as f:
                    for keys, sizes, ids in read_blocks(f, by_rank):
                        ends = np.cumsum(sizes)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NO_ID), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1]) if len(ends) else 0

    listed = spark.createDataFrame(jobs, "file string, start long").repartition(len(jobs))
    return listed.mapInArrow(load, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents encoded, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scratch.new_dir(spark, "tokens")
    return read(spark, out, write(docs, public_tokenizers.path("byte_bpe_50k.json"), out))
