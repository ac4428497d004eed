"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (1 to 3 characters of words in lower case, a space at either end) in
order of frequency.  A document's own most frequent n-grams are compared with each profile by the out-of-place measure:
the sum over the document's n-grams of the distance between both ranks, or of the profile's length where the profile
lacks the n-gram.  The nearest profile names the language; ties go to the smaller name.

Profiles are fitted on about ``per_lang`` labelled documents of each language at most, the distinct texts whose hash
falls in the matching share (a documented bound, see fit()); counts over them are exact.

Nulls and blanks: a null text or one without a letter (marks and digits are none) is ``und`` with score 0.  Without any
labelled row every text is ``und``.  An empty table stays empty.  Repeated rows: each is predicted; a fit takes equal
texts of a language once.  Whole texts count, whatever their length.  Extra columns are kept, lang_pred and score replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm import kernels as K
from sluice.llm import scratch

#: N-grams in a profile.
TOP = 300
#: Labelled documents of a language that a fit may take.
PER_LANG = 1500
#: A code point takes 21 bits of an n-gram's code.
BITS = 21


def _grams(texts: list[str | None]):
    """For each text the codes of its n-grams, occurrence by occurrence; none for a text without a letter.  Texts come in
    slices of bounded size.

    Code points are renumbered within a slice so that codes are small enough to count in an array; ``decode`` turns
    them into codes that mean the same everywhere.
    """
    for a, b in K.slices(texts, 400_000):
        _, codes, bounds = K.flat_codes(texts[a:b])
        low = K.word_table(False)[codes]
        count = np.concatenate([[0], np.cumsum(K.letters()[codes])])
        lettered = (count[bounds[1:]] > count[bounds[:-1]]).tolist()
        # each text on its own between spaces: a separator before every text and after the last
        padded = np.zeros(len(low) + b - a + 1, np.uint32)
        at = np.arange(len(low)) + np.repeat(np.arange(1, b - a + 1), np.diff(bounds))
        padded[at] = low
        letters, alphabet = renumber(padded)
        size = len(alphabet)
        one, two, three = letters[:-2], letters[1:-1], letters[2:]
        zero = int(np.flatnonzero(alphabet == 0)[0])
        mid = two != zero
        pairs = (letters[:-1] != zero) | (letters[1:] != zero)
        # a text owns the places from the space before it up to the space after it
        starts = bounds[:-1] + np.arange(b - a)
        ends = bounds[1:] + np.arange(1, b - a + 1)
        uni = two.astype(np.int64)
        bi = size + letters[:-1].astype(np.int64) * size + letters[1:]
        tri = size + size * size + (one.astype(np.int64) * size + two) * size + three

        def decode(g, alphabet=alphabet, size=size):
            al = np.concatenate([alphabet, [0]]).astype(np.int64)
            al[al == 0] = 32
            out = np.empty(len(g), np.int64)
            k = g < size
            out[k] = al[g[k]]
            k = (g >= size) & (g < size + size * size)
            x = g[k] - size
            out[k] = al[x // size] << BITS | al[x % size]
            k = g >= size + size * size
            x = g[k] - size - size * size
            out[k] = (al[x // (size * size)] << BITS | al[x // size % size]) << BITS | al[x % size]
            return out

        for s, t, some in zip(starts.tolist(), ends.tolist(), lettered, strict=True):
            if not some:
                yield np.zeros(0, np.int64), size, decode
                continue
            part, wide = slice(s, t - 1), slice(s, t)
            m, p = mid[part], pairs[wide]
            yield np.concatenate([uni[part][m], bi[wide][p], tri[part][m]]), size, decode


def renumber(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order of the code points, so that ties by code are ties by letters."""
    seen = np.zeros(0x110000, bool)
    seen[x] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    return number[x], alphabet


def _counted(g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs."""
    if size <= 64:
        n = np.bincount(g, minlength=1)
        at = np.flatnonzero(n)
        return at, n[at]
    return np.unique(g, return_counts=True)


def _top(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    if len(codes) > 4 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


@dataclass
class Profiles:
    """Languages and, by rank, the n-grams of each."""

    langs: list[str]
    grams: list[np.ndarray]
    top: int = TOP

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order, and the rank of each in each language (top where it has none)."""
        every = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.int64)
        rank = np.full((len(every), len(self.langs)), self.top, np.int32)
        for k, g in enumerate(self.grams):
            rank[np.searchsorted(every, g), k] = np.arange(len(g))
        return every, rank


def fit(docs: DataFrame, per_lang: int = PER_LANG, top: int = TOP) -> Profiles:
    """Profiles of docs (text, lang) from rows with both; about per_lang distinct texts of a language at most.

    Partitions hand on n-gram counts, so a language of any share of the rows is never gathered.  What reaches the driver
    is bounded by top n-grams for each language.
    """
    rows = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text", "lang").alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles([], [], top)
    # the hash below which about per_lang rows of a language lie
    bounds = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(2**63 - 1, int(2**64 * per_lang / n) - 2**63))))
    sample = rows.filter(F.col("h") <= F.element_at(bounds, F.col("lang"))).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches):
        held: dict[str, dict[int, int]] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang, (g, size, decode) in zip(langs, _grams(texts), strict=True):
                to = held.setdefault(lang, {})
                codes, n = _counted(g, size)
                for c, k in zip(decode(codes).tolist(), n.tolist(), strict=True):
                    to[c] = to.get(c, 0) + k
        for lang, to in held.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(to), "gram": list(to), "n": list(to.values())}, schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    counts = scratch.map_arrow(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).collect()
    grams = {k: [x.gram for x in sorted((x for x in best if x.lang == k), key=lambda x: x.r)] for k in sorted({x.lang for x in best})}
    return Profiles(list(grams), [np.array(g, np.int64) for g in grams.values()], top)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added (a column of such a name is replaced).

    score is 1 - nearest / mean distance of the others' profiles, between 0 and 1.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((profiles.langs, *profiles.table(), profiles.top))  # top n-grams per language
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches):
        langs, every, rank, top = shared.value
        for b in batches:
            out, score = [], []
            for g, size, decode in _grams(b.column(names.index(text)).to_pylist()):
                if not len(g) or not langs:
                    out.append("und")
                    score.append(0.0)
                    continue
                codes = decode(_top(*_counted(g, size), top))
                at = np.minimum(np.searchsorted(every, codes), len(every) - 1)
                ranks = np.where((every[at] == codes)[:, None], rank[at], top)
                own = np.arange(len(codes))[:, None]
                far = np.where(ranks == top, top, np.abs(ranks - own)).sum(axis=0)
                k = int(far.argmin())
                rest = np.delete(far, k)
                out.append(langs[k])
                score.append(float(1 - far[k] / max(1, rest.mean() if len(rest) else top * len(codes))))
            cols = [*b.columns, pa.array(out, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return scratch.map_arrow(docs, run, f"{kind}, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; profiles from labelled documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    profiles = fit(docs.filter("not held_out"))
    return predict(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")
