"""Benchmark decontamination by canonical templates.

A text's words (runs of letters, marks and digits, a point or comma between digits included) become a template: numbers,
units after a number and names (capitalised words inside a sentence) turn into typed placeholders, other words into
lower case.  Windows of WINDOW template words are hash-joined with those of the benchmark items, so a question with other
numbers, names or units still meets its original.  Each window is also taken with names as plain words, which finds
passages in capitals, and in a third template, where capitalised words at the start of a sentence are names too and a
name of several words is one placeholder.

Matches of one document and item on one diagonal of a template belong together.  They count if their slots are
consistent: equal values of the item stand for equal values in the document.  Where they aren't, unchanged runs of at
least RUN words count.  The item leaks if what counts on all its diagonals covers at least RUN words, or half of the
item's.

The documents' windows first pass a bitmap of BITMAP_BITS bits that is made from the items' hashes by aggregation; its
size is fixed, and what a fuller bitmap lets through wrongly the join removes.  Items of fewer than WINDOW words are
matched whole.  Templates that say little match unchanged only, that is their windows are hashed with the words behind
the placeholders: those of items of fewer than PLAIN words, and windows with fewer plain words than placeholders, unless
the item has no other windows.

Nulls: a null text has no windows, and an item without words leaks nowhere; rows with a null id count as no document or
item.  Rows of equal doc_id are one document, of equal item_id one item (any of them); items of equal texts are matched
once.  Empty tables give no leaks.  Extra columns are not looked at.  Very long texts are matched whole.
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

WINDOW, RUN, PLAIN = 8, 13, 4
BITMAP_BITS = 1 << 23
NUM, NAME, UNIT = (K.U64(x) for x in (0x4E554D, 0x4E414D45, 0x554E4954))
UNITS = (
    "kg g mg lb lbs oz ton tons t km m cm mm mi mile miles ft foot feet inch inches yd yards l ml litre litres liter liters"
    " s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars"
    " euro euros cent cents pound pounds usd eur gbp percent degree degrees c f kmh mph kb mb gb tb w kw kwh v a hz khz"
).split()
SCHEMA = "id long, kind int, size int, p int, h long, w int, n int, words int, vals array<long>"

#: Blank, apostrophes, hyphen.
_joints = np.array([0x20, 0x27, 0x2019, 0x2D])
_ends = np.zeros(0x110000, bool)
_ends[[ord(c) for c in ".!?:;\n…。！？"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    _, codes, bounds = K.flat_codes(words)
    return np.unique(K.segment_hashes(codes, bounds[:-1], bounds[1:]))


_units = _hashes(sorted(set(UNITS)))
_digit: np.ndarray | None = None


def digits() -> np.ndarray:
    """By code point: whether it is a number sign."""
    global _digit
    if _digit is None:
        _digit = (K.word_table(True) != 0) & (K.word_table(False) == 0)
    return _digit


@dataclass
class Template:
    """Tokens of some texts: a token's code, its value, its first word and, by text, the first token.

    Diagonals of one kind are comparable.  starts has the number of words as its last element.
    """

    kind: int
    codes: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    at: np.ndarray


def templates(texts: list[str | None]) -> tuple[list[Template], np.ndarray]:
    """Templates with names as slots, with names as words, with all capitalised words as joined slots; word bounds."""
    _, codes, bounds = K.flat_codes(texts)
    if not len(codes):
        return [], np.zeros(len(bounds), np.int64)
    low = K.word_table()[codes]
    number = digits()[codes]
    inside = low != 0
    if len(codes) > 2:
        joint = ((codes[1:-1] == 0x2E) | (codes[1:-1] == 0x2C)) & number[:-2] & number[2:]
        inside[1:-1] |= joint
    starts, ends = K.runs(inside, bounds)
    at = np.searchsorted(starts, bounds)
    if not len(starts):
        return [], at
    words = K.segment_hashes(np.where(low != 0, low, codes), starts, ends)
    count = np.concatenate([[0], np.cumsum(number)])
    is_num = count[ends] > count[starts]
    place = np.minimum(np.searchsorted(_units, words), len(_units) - 1)
    first = np.zeros(len(starts), bool)
    first[at[:-1][at[:-1] < len(starts)]] = True
    is_unit = (_units[place] == words) & np.concatenate([[False], is_num[:-1]]) & ~first
    stops = np.concatenate([[0], np.cumsum(_ends[codes])])
    first[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    upper = codes != low
    second = np.minimum(starts + 1, ends - 1)
    capital = ~is_num & upper[starts] & ~(upper[second] & (second > starts))
    plain = np.where(is_num, NUM, np.where(is_unit, UNIT, words))
    slots = np.where(capital & ~first & ~is_unit, NAME, plain)
    each = np.arange(len(words) + 1)
    out = [Template(0, slots, words, each, at), Template(0, plain, words, each, at)]
    # words of a name are parted by blanks, hyphens and apostrophes only
    parts = np.concatenate([[0], np.cumsum(~np.isin(codes, _joints))])
    named = capital & ~is_unit
    more = np.zeros(len(words), bool)
    more[1:] = named[1:] & named[:-1] & ~first[1:] & (parts[starts[1:]] == parts[ends[:-1]])
    begin = np.flatnonzero(~more)
    # a name's value depends on its words and their order
    place = each[:-1] - np.repeat(begin, np.diff(np.append(begin, len(words))))
    values = np.add.reduceat(np.where(place > 0, K.splitmix(words + place.astype(K.U64)), words), begin)
    out.append(Template(1, np.where(named, NAME, plain)[begin], values, np.append(begin, len(words)), np.searchsorted(begin, at)))
    return out, at


def _windows(t: Template, size: int):
    """(text, first token, hash of the template, hash of the words, whether it says little) of all windows of ``size``
    tokens that lie within a text.  The hash of the words is there for windows that say little."""
    template, at = t.codes, t.at
    n = len(template) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.view(K.U64), none.view(K.U64), np.zeros(0, bool)
    lanes = K.lanes(size)
    total = template[:n] * lanes[0]
    for k in range(1, size):
        total += template[k : n + k] * lanes[k]
    text = np.searchsorted(at, np.arange(len(template)), "right") - 1
    plain = np.concatenate([[0], np.cumsum((template != NUM) & (template != NAME) & (template != UNIT))])
    ok = np.flatnonzero(text[:n] == text[size - 1 :])
    poor = (2 * (plain[size:] - plain[:-size])[ok] < size) | (size < PLAIN)
    few = ok[poor]
    words = np.zeros(len(ok), K.U64)
    said = np.zeros(len(few), K.U64)
    for k in range(size):
        said += t.values[few + k] * lanes[k]
    words[poor] = K.splitmix(said + K.U64(size + WINDOW))
    return text[ok], ok, K.splitmix(total[ok] + K.U64(size)), words, poor


def _rows(ids, size, text, first, h, t: Template, at, slots: bool):
    """Rows of windows; those hashed with their words have no slots, as equal hashes have equal words."""
    vals = []
    held = np.where(slots & ((t.codes == NUM) | (t.codes == NAME) | (t.codes == UNIT)), t.values, 0).astype(K.U64).view(np.int64)
    for p in first.tolist():
        vals.append(held[p : p + size].tolist())
    counts = np.diff(at)[text]
    word = t.starts[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[t] for t in text.tolist()], pa.int64()),
            pa.array(np.full(len(first), t.kind), pa.int32()),
            pa.array(np.full(len(first), size), pa.int32()),
            pa.array(first - t.at[text], pa.int32()),
            pa.array(h.view(np.int64)),
            pa.array(word - at[text], pa.int32()),
            pa.array(t.starts[first + size] - word, pa.int32()),
            pa.array(counts, pa.int32()),
            pa.array(vals, pa.list_(pa.int64())),
        ],
        ["id", "kind", "size", "p", "h", "w", "n", "words", "vals"],
    )


def _of_items(batches):
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, j in K.slices(texts):
            found, at = templates(texts[i:j])
            for t in found:
                lens = np.diff(t.at)
                for size in np.unique(np.minimum(lens[lens > 0], WINDOW)).tolist():
                    text, first, h, said, poor = _windows(t, size)
                    mine = np.minimum(lens[text], WINDOW) == size
                    has = np.zeros(j - i, bool)
                    has[text[mine & ~poor]] = True
                    for use, hashes, slots in ((mine & poor, said, False), (mine & (~poor | (~has[text] & (size >= PLAIN))), h, True)):
                        yield _rows(ids[i:j], size, text[use], first[use], hashes[use], t, at, slots)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, item_words): each leak of an item (item_id, text) into a document (doc_id, text)."""
    spark = docs.sparkSession
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id"])
    equal = items.select("item_id", F.min("item_id").over(Window.partitionBy(F.sha2("text", 256))).alias("of"))
    items = items.join(equal.filter("item_id = of").select("item_id"), "item_id", "left_semi").withColumnRenamed("item_id", "id")
    index = scratch.materialize(scratch.map_arrow(items, _of_items, SCHEMA).distinct(), "index")
    # BITMAP_BITS / 32 rows at most
    cells = index.groupBy(F.expr(f"cast(pmod(h, {BITMAP_BITS}) div 32 as int) as cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 32) as int))")).alias("bits")).collect()
    sizes = sorted(r.size for r in index.select("size").distinct().collect())  # WINDOW values at most
    bitmap = np.zeros(BITMAP_BITS // 32, np.uint32)
    for r in cells:
        bitmap[r.cell] = r.bits & 0xFFFFFFFF
    shared = spark.sparkContext.broadcast(bitmap)

    def of_docs(batches):
        bits = shared.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in K.slices(texts):
                made, at = templates(texts[i:j])
                for t in made:
                    for size in sizes:
                        text, first, h, said, poor = _windows(t, size)
                        for some, hashes, slots in ((poor, said, False), (None if size >= PLAIN else ~poor, h, True)):
                            use = slice(None) if some is None else np.flatnonzero(some)
                            pos = (hashes[use] & K.U64(BITMAP_BITS - 1)).astype(np.int64)
                            hit = np.flatnonzero((bits[pos >> 5] >> (pos & 31).astype(np.uint32)) & 1)
                            hit = hit if some is None else use[hit]
                            if len(hit):
                                yield _rows(ids[i:j], size, text[hit], first[hit], hashes[hit], t, at, slots)

    found = scratch.map_arrow(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of_docs, SCHEMA)
    found = found.select(F.col("id").alias("doc_id"), F.col("p").alias("dp"), "h", "kind", "size", F.col("vals").alias("dvals")).distinct()
    met = found.join(index.select(F.col("id").alias("item_id"), "p", "h", "kind", "size", "w", "n", "words", "vals"), ["h", "kind", "size"])
    slots = F.filter(F.zip_with("vals", "dvals", lambda v, d: F.struct(v.alias("v"), d.alias("d"))), lambda x: x["v"] != 0)
    span = F.sequence("w", F.col("w") + F.col("n") - 1)
    runs = met.groupBy("doc_id", "item_id", "kind", (F.col("dp") - F.col("p")).alias("diagonal")).agg(
        F.array_distinct(F.flatten(F.collect_set(span))).alias("covers"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("vals") == F.col("dvals"), span)))).alias("same"),
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"),
        F.max("words").alias("item_words"),
    )
    consistent = F.size(F.array_distinct(F.transform("slots", lambda x: x["v"]))) == F.size("slots")
    # words of an unchanged run: sorted words less their places are equal within a run
    same = F.transform(F.array_sort("same"), lambda x, i: F.struct(x.alias("w"), (x - i).alias("run")))
    long = F.transform(F.filter("same", lambda x: F.size(F.filter("same", lambda y: y["run"] == x["run"])) >= RUN), lambda x: x["w"])
    runs = runs.withColumn("same", same).withColumn("covers", F.when(consistent, F.col("covers")).otherwise(long))
    runs = runs.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("covered"), F.max("item_words").alias("item_words"))
    enough = (F.col("covered") >= RUN) | (2 * F.col("covered") >= F.col("item_words"))
    found = runs.filter(enough).select("doc_id", F.col("item_id").alias("of"), F.col("covered").cast("long"), F.col("item_words").cast("long"))
    return found.join(equal, "of").select("doc_id", "item_id", "covered", "item_words")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of all benchmark items into all documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
