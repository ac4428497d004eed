"""Spot-signature fingerprints of documents.

An anchor is a common word of the languages listed below; a signature is an anchor with the CHAIN content words (words
that are no anchors) that follow it.  A text's fingerprint is the set of its distinct signatures, written as base64 of
their sorted 32-bit hashes; it covers the whole text.  Likeness is the Jaccard similarity of two such sets.

A text in which no anchor is followed by a whole chain is fingerprinted by all chains of its words, and one too short for
that by its words in a row.  A text without words (null, blank) has the empty fingerprint; two empty ones are alike (1).
Words are runs of letters, marks and digits in lower case.

``alike`` links similar documents: signature sets partitioned by length, compared through pruned Jaccard.
``neighbours`` pairs every row with the next one in descending doc_id order, the last with the first; rows of equal
doc_id follow one another by text, null ids come last.  A table of one row pairs it with itself; an empty one is empty.
Very long texts are read whole.  Extra columns are kept by ``fingerprints`` and not looked at by the others.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import kernels as K
from sluice.llm import near_dedup, scratch

#: Content words in a signature.
CHAIN = 2
ANCHORS = (
    "the a an and of to in is are was were that this it for on with as by at be or from have has had not but they he she"
    " le la les de des du et un une que qui en est dans par pour sur au aux avec ne pas se il elle ce"
    " der die das und von zu mit den dem ein eine einer ist nicht sich auf für als auch im es des"
    " el los las y del que en un una por con para se su al lo no más como"
).split()
#: Buckets for each shuffle partition; several small ones even out what a partition's hash brings together.
BUCKETS = 8
#: Ranges that doc_ids are dealt out over at most.
CUTS = 1 << 11


def _hashes(words: list[str]) -> np.ndarray:
    _, codes, bounds = K.flat_codes(words)
    return K.segment_hashes(codes, bounds[:-1], bounds[1:])


_anchors = np.unique(_hashes(sorted(set(ANCHORS))))


def signatures(texts: list[str | None], chain: int = CHAIN) -> Iterator[np.ndarray]:
    """For each text its sorted distinct signatures as 32-bit numbers."""
    for a, b in K.slices(texts):
        _, codes, bounds = K.flat_codes(texts[a:b])
        low = K.word_table()[codes]
        starts, ends = K.runs(low != 0, bounds)
        words = K.segment_hashes(low, starts, ends)
        doc = np.searchsorted(bounds, starts, "right") - 1
        place = np.minimum(np.searchsorted(_anchors, words), len(_anchors) - 1)
        anchor = _anchors[place] == words
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        next_at = np.searchsorted(content, spots)
        whole = next_at + chain <= len(content)
        spots, next_at = spots[whole], next_at[whole]
        if len(spots):
            inside = doc[content[next_at + chain - 1]] == doc[spots]
            spots, next_at = spots[inside], next_at[inside]
        made = words[spots]
        for k in range(chain):
            made = K.splitmix(made + words[content[next_at + k]])
        made = (made >> K.U64(32)).astype(np.uint32)
        cuts = np.searchsorted(doc[spots], np.arange(b - a + 1))
        at = np.searchsorted(starts, bounds)
        for d in range(b - a):
            if cuts[d] < cuts[d + 1]:
                yield np.unique(made[cuts[d] : cuts[d + 1]])
                continue
            w = words[at[d] : at[d + 1]]
            n = min(len(w), chain + 1)
            mixed = w[: len(w) - n + 1] if n else w
            for k in range(1, n):
                mixed = K.splitmix(mixed + w[k : len(w) - n + 1 + k])
            yield np.unique((mixed >> K.U64(32)).astype(np.uint32))


def written(s: np.ndarray) -> str:
    """A fingerprint as text."""
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def parsed(text: str) -> np.ndarray:
    """The signatures in a written fingerprint."""
    return np.frombuffer(base64.b64decode(text), "<u4")


def likeness(s: np.ndarray, t: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without a merge where the sizes alone keep it below ``least``."""
    if not len(s) and not len(t):
        return 1.0
    if min(len(s), len(t)) < least * max(len(s), len(t)) or not len(s) or not len(t):
        return 0.0
    both = len(s) + len(t) - len(np.union1d(s, t))
    return both / (len(s) + len(t) - both)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint and n_signatures added (columns of such names are replaced)."""
    docs = docs.drop("fingerprint", "n_signatures")
    names = docs.columns

    def run(batches):
        for b in batches:
            sets = list(signatures(b.column(names.index(text)).to_pylist()))
            cols = [*b.columns, pa.array(map(written, sets), pa.string()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "fingerprint", "n_signatures"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return scratch.map_arrow(docs, run, f"{kind}, fingerprint string, n_signatures long")


def set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, s, parity) of docs (doc_id, text): the signatures as sorted 64-bit numbers and their bitmap."""

    def run(batches):
        for b in batches:
            sets = [np.sort(K.splitmix(s.astype(K.U64))) for s in signatures(b.column(1).to_pylist())]
            cols = [
                b.column(0),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([near_dedup.parity(s) if len(s) else b"" for s in sets], pa.binary()),
                pa.array([s.view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "digest", "s", "parity", "signs"])

    schema = "doc_id long, n int, digest binary, s binary, parity binary, signs array<long>"
    return scratch.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def alike(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_signatures and class_id (the smallest doc_id reachable over pairs of at least this Jaccard similarity).

    Equal sets form a class, of which the smallest doc_id goes on.  Sets are partitioned by length, so that two that can
    reach the threshold lie in one partition or in neighbouring ones; a set also visits the next one.  Within a partition
    the inverted index holds a set's rarest signatures only, as many as two similar sets must share one of.  Candidates
    are linked to a pivot of their lists first; what lists still hold from different classes is compared block by block,
    pruned by the bitmaps' bound, and confirmed on full sets.  So no list is expanded into all its pairs.

    Texts without words are linked with nothing; a null doc_id gets a null class.  Rows of equal doc_id are one document.
    """
    rows = scratch.materialize(set_rows(docs), "signatures")
    classes = rows.filter("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("rep")).filter("rep is not null")
    known = rows.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("id"), "n", "s", "parity", "signs").dropDuplicates(["id"])
    known = scratch.materialize(known, "classes")
    signs = known.select("id", "n", F.explode("signs").alias("sign"))
    counts = signs.groupBy("sign").agg(F.count("*").alias("c")).filter("c > 1")
    # signatures of one set only come first in the order of rarity; they use up places but make no list
    held = signs.join(counts, "sign").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "sign"))).alias("held"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    single = F.col("n") - F.size("held")
    held = held.withColumn("held", F.slice("held", F.lit(1), F.greatest(prefix - single, F.lit(0))))
    part = F.floor(F.log(F.col("n").cast("double")) / np.log(max(100 / percent, 1.05)) + 1e-9)
    lists = held.select("id", part.alias("part"), F.explode("held.sign").alias("sign"))
    lists = lists.select("id", "sign", F.explode(F.array("part", F.col("part") + 1)).alias("part")).select("id", F.xxhash64("part", "sign").alias("bk"))
    longer = lists.groupBy("bk").agg(F.count("*").alias("c"), F.min_by("id", F.xxhash64("bk", "id")).alias("pivot")).filter("c > 1").select("bk", "pivot")
    members = scratch.materialize(lists.join(longer, "bk").select("bk", "id", "pivot"), "lists")
    sets, lengths = known.select("id", "s"), known.select("id", "n")
    near = members.filter("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("c"))
    near = near.join(lengths, "id").join(lengths.select(F.col("id").alias("pivot"), F.col("n").alias("pn")), "pivot").filter(F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent)
    best = near.groupBy("id").agg(F.max(F.struct("c", "pivot")).alias("x"), F.min_by("pivot", F.xxhash64("id", "pivot")).alias("y"))
    best = best.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("x.pivot", "y"))).alias("b"))
    comps = near_dedup.linked(best, members.select("bk", "id"), known.select("id", "n", "parity"), sets, percent)
    out = rows.select("doc_id", "n", "digest").join(classes, ["n", "digest"], "left").join(comps, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_signatures"), F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("comp", "rep")).alias("class_id"))


def _place(key: Column, cuts: list[int], low: int = 0) -> Column:
    """The number of cuts up to the key, by halving."""
    if not cuts:
        return F.lit(low)
    k = len(cuts) // 2
    return F.when(key < cuts[k], _place(key, cuts[:k], low)).otherwise(_place(key, cuts[k + 1 :], low + k + 1))


def _buckets(docs: DataFrame, parts: int) -> tuple[DataFrame, list]:
    """docs with key and a bucket that rises with it, and (bucket, smallest, greatest key) of each bucket that has rows.

    The cuts are quantiles of the keys, so buckets have like numbers of rows however the ids lie.
    """
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = min(parts, CUTS)
    cuts = docs.agg(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0]  # CUTS numbers at most
    docs = docs.withColumn("bucket", _place(F.col("key"), sorted(set(cuts or []))))
    found = docs.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    return docs, sorted(map(tuple, found))


def neighbours(docs: DataFrame, run, schema: str) -> DataFrame:
    """run over batches of rows (doc_id, text, next text) in descending doc_id order within each task.

    One shuffle of the texts; a bucket's last row finds its neighbour in a copy of the next bucket's first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, ends = _buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), BUCKETS * parts)
    guests = [(high, ends[k + 1][0] if k + 1 < len(ends) else ends[0][0]) for k, (_, _, high) in enumerate(ends)]
    known = spark.createDataFrame(guests, "key long, visits int")  # a row for each bucket
    dealt = dealt.join(F.broadcast(known), "key", "left")
    places = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.when(F.col("visits").isNotNull(), F.struct(F.col("visits").alias("bucket"), F.lit(1).alias("guest")))))
    rows = dealt.select("doc_id", "key", "text", F.explode(places).alias("at")).select("at.bucket", "at.guest", "key", "doc_id", "text")
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), "text").select("bucket", "guest", "doc_id", "text")

    def paired(batches):
        held = None
        for b in batches:
            ids, texts, nexts = [], [], []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] == r[0] and not held[1]:
                    ids.append(held[2])
                    texts.append(held[3] or "")
                    nexts.append(r[3] or "")
                held = r
            if ids:
                yield ids, texts, nexts

    return scratch.map_arrow(rows, lambda batches: run(paired(batches)), schema)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for ids, texts, nexts in rows:
        for a, b in K.slices(texts):
            own, new = texts[a:b], [edited(t, u) for t, u in zip(texts[a:b], nexts[a:b], strict=True)]
            # a row's next text mostly is the following row's own
            lone = [k for k in range(a, b) if k + 1 >= b or nexts[k] is not texts[k + 1]]
            sets, changed = list(signatures(own)), list(signatures(new))
            other = dict(zip(lone, signatures([nexts[k] for k in lone]), strict=True))
            after = [other[k] if k in other else sets[k + 1 - a] for k in range(a, b)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[a:b], pa.int64()),
                    pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
                    pa.array(map(written, sets), pa.string()),
                    pa.array(map(written, changed), pa.string()),
                    pa.array(map(likeness, sets, changed), pa.float64()),
                    pa.array(map(likeness, sets, after), pa.float64()),
                ],
                names,
            )


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"), _compare, SCHEMA)
