"""MinHash near-duplicate components with odd sketches.

Every text becomes the set of its distinct word shingles.  Equal sets form a class, of which the smallest doc_id goes on.
Banded MinHash puts classes into buckets.  The MinHash samples are folded into a 512-bit parity bitmap, the odd sketch.
The population count of two sketches' XOR estimates their similarity, the more precisely the higher it is, and a bucket's
pairs become candidates only if the estimate lies within MARGIN of the threshold or above (``apart_limit``).  What passes
meets a larger parity bitmap over the whole set, whose count bounds the symmetric difference from below, so that it
rejects without ever losing a pair.  Candidates are confirmed on full sets in exact integers.

No bucket is expanded into all its pairs.  First every member meets one pivot per bucket, and of its pivots that pass
the estimate three are confirmed.  What a bucket still holds from different components is compared in blocks of bounded
size, sketch against sketch; of the pairs that pass, the likeliest for each member and component is confirmed, and then
whatever still crosses components.  So a bucket of any size is dealt out over tasks, and no candidate is capped.

A pair at the threshold shares no bucket with a chance of (1 - 0.8**5)**30 < 1e-5, less above it; its estimate falls
below the margin with a chance of about 1e-6 (tests/llm draws them).

Nulls and short texts: a null or blank text has no shingles, stays alone and is kept; a text of fewer words than a
shingle has one, its words in a row.  Rows of equal doc_id are one node.  A null doc_id gets a null component and is
kept.  An empty table gives an empty result.  Extra columns are not looked at.  A very long text is one row of the sets
that are confirmed, 8 bytes a distinct shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import kernels as K
from sluice.llm import scratch

BANDS, ROWS = 30, 5
SAMPLES = BANDS * ROWS
ODD_WORDS = 8
#: Members of a bucket that meet in one block.
BLOCK = 256
#: By how much less than the threshold a sketch may estimate a pair's similarity.
MARGIN = 0.25
#: Parts that the rows of one class of equal sets are dealt over.
SALT = 16

_seeds = (K.splitmix(np.arange(1000, 1000 + SAMPLES)) >> K.U64(32)).astype(np.uint32)[:, None]
_mults = ((K.splitmix(np.arange(5000, 5000 + SAMPLES)) >> K.U64(32)).astype(np.uint32) | np.uint32(1))[:, None]
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_word = np.ones(256, bool)
_word[[0x20, *range(9, 14)]] = False


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit shingles of ``width`` words, A-Z in lower case."""
    for a, b in K.slices(texts):
        _, data, bounds = K.flat_bytes(texts[a:b])
        starts, ends = K.runs(_word[data], bounds)
        words = K.segment_hashes(_lower[data], starts, ends)
        at = np.searchsorted(starts, bounds)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            w = words[i:j]
            n = max(1, len(w) - width + 1) if len(w) else 0
            k = min(width, len(w))
            mixed = np.zeros(n, K.U64)
            for p in range(k):
                mixed = K.splitmix(mixed + w[p : p + n])
            yield np.unique(mixed)


def signature(s: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit MinHash values of a non-empty set."""
    h = (s >> K.U64(32)).astype(np.uint32)
    out = None
    for a in range(0, len(h), 1024):
        x = h[None, a : a + 1024] ^ _seeds
        x *= _mults
        m = x.min(axis=1)
        out = m if out is None else np.minimum(out, m)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each row of signatures; the band's number is part of the key."""
    v = sigs.reshape(len(sigs), BANDS, ROWS).astype(K.U64)
    key = np.broadcast_to(K.splitmix(np.arange(BANDS)), v.shape[:2])
    for r in range(ROWS):
        key = K.splitmix(key + v[:, :, r])
    return key.view(np.int64)


def odd_sketches(sigs: np.ndarray) -> np.ndarray:
    """The samples of each row folded into a parity bitmap of ODD_WORDS 64-bit words."""
    bits = 64 * ODD_WORDS
    at = K.splitmix(sigs.astype(K.U64) + (np.arange(SAMPLES, dtype=np.int64).astype(K.U64) << K.U64(32))) & K.U64(bits - 1)
    flat = (np.arange(len(sigs))[:, None] * bits + at.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=len(sigs) * bits) & 1).astype(np.uint8).reshape(len(sigs), bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def parity(s: np.ndarray) -> bytes:
    """Parity bitmap of a whole set, of a power of two of bits, at least four to an element."""
    bits = max(64, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & K.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap in ``words`` 64-bit words, by adding its parts; exact as positions are low bits."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def apart_limit(percent: int) -> int:
    """The greatest XOR population count of two odd sketches at which their estimated similarity is within the margin.

    Each sample in which two sets differ flips two bits; so many flips leave so many odd ones on average.
    """
    bits, flips = 64 * ODD_WORDS, 2 * SAMPLES * (1 - percent / 100 + MARGIN)
    return int(bits * (1 - (1 - 2 / bits) ** flips) / 2)


FEATURES = "doc_id long, n int, d1 long, d2 long, bands array<long>, odd array<long>, parity binary"


def _features(width: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sets = shingle_sets(texts, width)
            for i in range(0, len(ids), 512):
                part = [next(sets) for _ in ids[i : i + 512]]
                full = [k for k, s in enumerate(part) if len(s)]
                sigs = np.stack([signature(part[k]) for k in full]) if full else np.zeros((0, SAMPLES), np.uint32)
                keys, odd, at = band_keys(sigs), odd_sketches(sigs), {k: r for r, k in enumerate(full)}
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() for s in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i : i + 512], pa.int64()),
                        pa.array([len(s) for s in part], pa.int32()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([keys[at[k]].tolist() if k in at else [] for k in range(len(part))], pa.list_(pa.int64())),
                        pa.array([odd[at[k]].tolist() if k in at else [] for k in range(len(part))], pa.list_(pa.int64())),
                        pa.array([parity(s) if len(s) else b"" for s in part], pa.binary()),
                    ],
                    ["doc_id", "n", "d1", "d2", "bands", "odd", "parity"],
                )

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            held, got, size = [], [], 0
            for d, s in zip(ids, shingle_sets(texts, width), strict=True):
                held.append(d)
                got.append(s.tobytes())
                size += s.nbytes
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(got, pa.binary())], ["id", "s"])
                    held, got, size = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(got, pa.binary())], ["id", "s"])

    return run


def _linked(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold."""
    one = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return scratch.map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb"), _linked(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id on an edge (a, b): the smallest id that it reaches.

    Alternating large-star and small-star steps; each is two shuffles of the edges, written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before, rows = None, 2 * edges.count()
    while True:
        sym = scratch.union(e, e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        last, e = e, scratch.materialize(scratch.union(small, low.select("u", F.col("m").alias("v"))).distinct(), "stars", rows)
        scratch.forget(last)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        # a step makes at most two edges of each
        before, rows = now, 2 * now[0]
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return scratch.union(e.select(F.col("u").alias("id"), F.col("v").alias("comp")), roots)


def _blocks(percent: int, best: bool):
    """Streams sorted (bk, i, j, side, ...) rows; in each block, pairs across sides and components that the sketches allow.

    Odd sketches (where there are any) come first, then the bitmaps of the sets.  With ``best``, for each row and component
    only the pair of the least bound.
    """
    limit = apart_limit(percent)

    def pairs(rows: list, out: list) -> None:
        left, right = [r for r in rows if r[3] == 0], [r for r in rows if r[3] == 1]
        if not left or not right:
            return
        by: dict[int, list] = {}
        for r in right:
            by.setdefault(len(r[7]), []).append(r)
        banks = []
        for rs in by.values():
            odd = np.array([r[9] for r in rs], np.int64).view(np.uint64) if rs[0][9] is not None else None
            banks.append((np.frombuffer(b"".join(r[7] for r in rs), np.uint64).reshape(len(rs), -1), *(np.array([r[k] for r in rs]) for k in (4, 5, 6, 8)), odd))
        for r in left:
            mine, sketch = np.frombuffer(r[7], np.uint64), np.array(r[9], np.int64).view(np.uint64) if r[9] is not None else None
            for bits, ids, comps, ns, lone, odd in banks:
                fit = (comps != r[5]) & (~lone | (ids > r[4])) & (100 * np.minimum(ns, r[6]) >= percent * np.maximum(ns, r[6]))
                if odd is not None:
                    fit &= np.bitwise_count(odd ^ sketch).sum(axis=1, dtype=np.int64) <= limit
                at = np.flatnonzero(fit)
                if not len(at):
                    continue
                words, them = min(len(mine), bits.shape[1]), bits[at]
                if bits.shape[1] != words:
                    them = np.bitwise_xor.reduce(them.reshape(len(at), -1, words), axis=1)
                apart = np.bitwise_count(them ^ fold(mine, words)).sum(axis=1, dtype=np.int64)
                # |S ^ T| >= apart, and the threshold allows |S ^ T| <= (100 - p)(|S| + |T|) / (100 + p)
                over = apart * (100 + percent) - (100 - percent) * (ns[at] + r[6])
                hit, over = at[over <= 0], over[over <= 0]
                if best and len(hit) > 1:
                    order = np.lexsort((ids[hit], over, comps[hit]))
                    hit, over = hit[order], over[order]
                    few = np.unique(comps[hit], return_index=True)[1]
                    hit, over = hit[few], over[few]
                out += [(r[4], x, c, o) for x, c, o in zip(ids[hit].tolist(), comps[hit].tolist(), over.tolist(), strict=True)]

    def written(out: list):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["a", "b", "cb", "bound"])

    def run(batches):
        key, held, out = None, [], []
        for b in batches:
            for r in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if r[:3] != key:
                    pairs(held, out)
                    key, held = r[:3], []
                    if len(out) > BLOCK * BLOCK:
                        yield written(out)
                        out = []
                held.append(r)
        pairs(held, out)
        yield written(out)

    return run


def _crossing(members: DataFrame, comps: DataFrame, known: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different components and may reach the threshold.

    With ``best``, for each a and component only its likeliest pair.  A bucket's members outside its main component meet
    all its members, both dealt out over blocks of about BLOCK.
    """
    placed = members.join(comps, "id", "left").select("bk", "id", F.coalesce("comp", "id").alias("comp"))
    tally = placed.groupBy("bk", "comp").agg(F.count("*").alias("c")).groupBy("bk").agg(F.sum("c").alias("size"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most")).filter("most < size")
    odd = F.col("odd") if "odd" in known.columns else F.lit(None).cast("array<long>")
    mixed = placed.join(tally, "bk").join(known.select("id", "n", "parity", odd.alias("odd")), "id")
    lone = (F.col("comp") != F.col("main")).alias("lone")
    spread = F.xxhash64("id", "bk")
    n_left, n_right = F.ceil((F.col("size") - F.col("most")) / BLOCK), F.ceil(F.col("size") / BLOCK)
    row = ["id", "comp", "n", "parity"]
    left = mixed.filter(lone).select("bk", F.pmod(spread, n_left).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), n_right - 1)).alias("j"), F.lit(0).alias("side"), *row, lone, "odd")
    right = mixed.select("bk", F.explode(F.sequence(F.lit(0).cast("long"), n_left - 1)).alias("i"), F.pmod(spread, n_right).alias("j"), F.lit(1).alias("side"), *row, lone, "odd")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.union(left, right).repartition(parts, "bk", "i", "j").sortWithinPartitions("bk", "i", "j", "side")
    found = scratch.map_arrow(dealt, _blocks(percent, best), "a long, b long, cb long, bound long")
    return found.groupBy("a", "cb").agg(F.min_by("b", F.struct("bound", "b")).alias("b")).select("a", "b") if best else found.select("a", "b").distinct()


def linked(first: DataFrame, members: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, comp) of ids with links: the components of all pairs within a bucket whose full sets reach the threshold.

    first: candidate pairs (a, b) to begin with; members: (bk, id); known: (id, n, parity) with the bitmap of the whole set
    and, where candidates come from MinHash, odd with the odd sketch; sets: (id, s).
    """
    edges = scratch.materialize(_verify(first, sets, percent), "edges")
    comps, held = components(edges), [edges]
    # what a bucket still holds from different components: the likeliest links first, then all that are left
    for only in (True, False):
        more = scratch.materialize(_verify(_crossing(members, comps, known, percent, only), sets, percent), "edges")
        held.append(more)
        if more.isEmpty():
            # the likeliest by estimate may all fail where others link
            continue
        edges = scratch.union(edges, more)
        comps = components(edges)
    scratch.forget(*held)
    return comps


def with_classes(rows: DataFrame, classes: DataFrame, comps: DataFrame, key: list[str]) -> DataFrame:
    """rows (doc_id, n, key...) with comp: that of the row's class of equal sets (key..., rep, copies), else of the row.

    A class of very many rows is dealt over SALT parts; a class of one row has nothing to look up by key.
    """
    many = classes.filter("copies > 1").join(comps, F.col("rep") == F.col("id"), "left").select(*key, F.coalesce("comp", "rep").alias("of_class"))
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(many, [*key, "salt"], "left")
    out = out.join(comps, F.col("doc_id") == F.col("id"), "left")
    own = F.coalesce("of_class", "comp", "doc_id")
    return out.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, own).otherwise(F.col("doc_id"))).alias("comp"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = scratch.materialize(scratch.map_arrow(docs, _features(width), FEATURES), "features")
    classes = feats.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("rep is not null")
    n = feats.count()  # of a written table; later tables are at most so long, or so many times as long
    classes = scratch.materialize(classes, "classes", n)

    bands = feats.select("doc_id", "bands").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.explode("bands").alias("bk")).distinct()
    buckets = bands.groupBy("bk").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.materialize(bands.join(buckets.select("bk"), "bk").select("bk", "id"), "members", BANDS * n)

    wanted = members.select("id").distinct()
    known = scratch.materialize(
        feats.filter("n > 0").join(wanted, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "n", "odd", "parity").dropDuplicates(["id"]),
        "known",
        n,
    )
    sets = scratch.materialize(scratch.map_arrow(docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi"), _sets(width), "id long, s binary").dropDuplicates(["id"]), "sets", 8 * n)  # wide rows

    # each member and, of its buckets' pivots that pass the estimate, the nearest, the farthest and another
    pivots = members.groupBy("bk").agg(F.min_by("id", F.xxhash64("bk", "id")).alias("pivot"))
    star = members.join(pivots, "bk").filter("id <> pivot").select("id", "pivot").distinct()
    mine, theirs = known.select("id", "n", "odd"), known.select(F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("odd").alias("podd"))
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("podd")[k])) for k in range(ODD_WORDS)))
    scored = star.join(mine, "id").join(theirs, "pivot").filter(F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent).select("id", "pivot", apart.alias("apart")).filter(F.col("apart") <= apart_limit(percent))
    best = scored.groupBy("id").agg(F.min(F.struct("apart", "pivot")).alias("x"), F.max(F.struct("apart", "pivot")).alias("y"), F.min_by("pivot", F.xxhash64("id", "pivot")).alias("z"))
    best = best.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("x.pivot", "z", "y.pivot"))).alias("b"))
    comps = linked(best, members, known, sets, percent)
    scratch.forget(members, known, sets)

    out = with_classes(feats.select("doc_id", "n", "d1", "d2"), classes, comps, ["n", "d1", "d2"])
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of two-word shingle sets over all of documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
