"""Cross-site boilerplate lines: lines that stand on many distinct sites go, but for their first occurrence.

A line is its text between line feeds without spaces at either end; it counts if it has at least ``min_words`` words,
parted by single spaces; with min_words = 1, as the query and the pipeline have it, every line that isn't blank counts.
Its spread is the number of distinct sites (``source``) that it stands on.  Every line hash gets a HyperLogLog sketch of
its sites, merged by aggregation, which starts before the shuffle.  Where the estimate lies near the threshold the
distinct sites are counted exactly; elsewhere the estimate decides.  A line of at least min_sites sites is taken out of
every document but the one of the smallest doc_id, where its first occurrence stays.  DataFrame functions only.

One shuffle of line hashes, small ones of candidates, and one of the texts, which get the places of lines to drop.

Nulls: a null text stays null; a null source is no site; a null doc_id never holds the first occurrence, so rows
without one lose such lines.  Rows of equal doc_id are treated alike, each by itself.  Empty texts and tables stay.
A document of which no line remains has the empty text.  A text of very many lines is split like any other; its places to
drop are one array.  Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.scratch import fresh, union

MIN_SITES = 10
MIN_WORDS = 4
#: What a line that isn't blank has.
FULL = r"[^\x09-\x0D ]"
#: log2 of the sketch's registers; its relative standard error is about 1.04 / sqrt(2**LG_K).
LG_K = 12


def line_hash(line: Column, min_words: int) -> Column:
    """A line's 64-bit hash, null where it doesn't count."""
    bare = F.trim(line)
    if min_words <= 1:
        return F.when(bare.rlike(FULL), F.xxhash64(bare))
    return F.when(F.length(bare) - F.length(F.replace(bare, F.lit(" "))) >= min_words - 1, F.xxhash64(bare))


def _lines(docs: DataFrame, min_words: int, *columns: str | Column) -> DataFrame:
    """The given columns, i (the line's place) and h of every line that counts."""
    lines = docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.withColumn("line", line_hash(F.col("line"), min_words)).withColumnRenamed("line", "h").filter("h is not null")


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K) -> DataFrame:
    """(h, first_doc) of lines on at least min_sites distinct sites."""
    lines = _lines(docs, min_words, "doc_id", "source")
    site = F.when(F.col("source").isNotNull(), F.xxhash64("source"))
    # sketches, occurrences and the extremes of the site hashes combine before the shuffle
    spread = lines.groupBy("h").agg(
        F.count("source").alias("n"), F.min(site).alias("low"), F.max(site).alias("high"), F.min("doc_id").alias("first_doc"), F.hll_sketch_agg("source", F.lit(lg_k)).alias("sketch")
    )
    spread = spread.filter((F.col("n") >= min_sites) & ((F.col("low") != F.col("high")) | (F.lit(min_sites) <= 1)))
    spread = spread.select("h", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
    slack = max(1, round(0.25 * min_sites))
    far = spread.filter(F.col("sites") > min_sites + slack).select("h", "first_doc")
    near = spread.filter(F.col("sites").between(min_sites - slack, min_sites + slack)).select("h", "first_doc")
    # distinct first, so that a frequent line doesn't meet its candidates in one task
    exact = lines.select("h", "source").distinct().join(near, "h").groupBy("h", "first_doc").agg(F.count("source").alias("sites")).filter(F.col("sites") >= min_sites)
    return union(far, exact.select("h", "first_doc"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K) -> DataFrame:
    """docs with text without the boilerplate and removed_lines added (a column of that name is replaced)."""
    docs = docs.drop("removed_lines")
    doc, version, gone = fresh(docs.columns, "doc", "version", "gone")
    flagged = spread_lines(docs, min_sites, min_words, lg_k)
    # a text's hash tells rows of equal doc_id apart; equal rows lose the same places
    held = _lines(docs, min_words, F.col("doc_id").alias(doc), F.xxhash64("text").alias(version)).join(flagged, "h")
    held = held.groupBy(doc, version, "h").agg(F.collect_set("i").alias("at"), F.first("first_doc").alias("first_doc"))
    places = F.when(F.col(doc) == F.col("first_doc"), F.array_remove("at", F.array_min("at"))).otherwise(F.col("at"))
    held = held.groupBy(doc, version).agg(F.flatten(F.collect_list(places)).alias(gone))
    cut = docs.join(held, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(version)), "left")
    # the parts are bound once, as an argument of the outer transform
    rest = lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i)), "\n")
    some = F.size(gone) > 0
    text = F.when(some, F.get(F.transform(F.array(F.split("text", "\n")), rest), F.lit(0))).otherwise(F.col("text")).alias("text")
    return cut.select(*(text if c == "text" else F.col(c) for c in docs.columns), F.when(some, F.size(gone)).otherwise(0).cast("long").alias("removed_lines"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without cross-site boilerplate lines of any length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return dedup_lines(docs, min_words=1).select("doc_id", "text", "removed_lines")


OP6_SQL = f"""
with l as (
  select doc_id, source, i, parts[i] as line, trim(parts[i], ' ') as bare
  from (select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as i
        from (select doc_id, source, string_split(text, chr(10)) as parts from documents where text is not null))
), k as (
  select *, regexp_matches(bare, '{FULL}') as counts from l
), s as (
  select bare, min(doc_id) as first_doc from k where counts group by bare having count(distinct source) >= {MIN_SITES}
), m as (
  select k.*, s.first_doc, row_number() over (partition by k.doc_id, k.bare order by k.i) as nth
  from k left join s on k.counts and k.bare = s.bare
), c as (
  select doc_id, i, line, first_doc is null or (doc_id = first_doc and nth = 1) as keep from m
)
select d.doc_id,
  case when d.text is null then null else coalesce(c.text, '') end as text, coalesce(c.removed, 0) as removed_lines
from documents d left join (
  select doc_id, string_agg(line, chr(10) order by i) filter (where keep) as text,
    cast(sum(case when keep then 0 else 1 end) as bigint) as removed
  from c group by doc_id) c on d.doc_id = c.doc_id
"""
