"""WARC archives: a writer, a normaliser for monolithic gzip files and an indexed reader.

``write`` makes one gzip stream of a whole partition's records, as dumps often come.  ``normalise`` inflates such a
stream once, in bounded pieces, rewrites every record as a gzip member of its own and puts a sidecar index beside the
file (offset, length, type and id of each record), so that ``read`` and others can fetch single records.

Records of equal payloads of at least ``revisit_from`` bytes: the one of the largest page_id is a response, the others
are revisits that refer to it and carry no payload.  Smaller payloads are responses throughout.

Nulls: a null html is the empty payload, a null url the empty target.  A null page_id stays null and is a response.
Repeated rows of the largest page_id are responses each.  An empty table makes no file.  Control characters and
non-ASCII signs of a url are percent-encoded.  A page of any length is written and read in one piece, and normalised in
pieces of bounded size.  Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import scratch

REVISIT_FROM = 1000
#: Parts that the pages of one digest are dealt over.
SALT = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    tail = name.rpartition(":")[2].rstrip(">")
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit where refers_to is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_name(refers_to)}\r\n" if refers_to is not None else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {'revisit' if refers_to is not None else 'response'}\r\nWARC-Record-ID: {_name(page_id)}\r\nWARC-Date: {EPOCH}\r\n"
        f"WARC-Target-URI: {quote(url or '', safe=chr(37) + ':/?#[]@!$&' + chr(39) + '()*+,;=~')}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines if k}


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or of many members, in bounded pieces."""
    z, fresh = zlib.decompressobj(31), True
    for c in chunks:
        while c:
            if z.eof:
                z, fresh = zlib.decompressobj(31), True
            fresh = False
            yield z.decompress(c, PIECE)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, PIECE)
            c = z.unused_data
    if not fresh and not z.eof:
        raise ValueError("the gzip stream ends early")


def records(plain: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(header, pieces of the whole record) of each record of a plain WARC stream.  Read a record's pieces to their end."""
    held = b""

    def need(n: int) -> bool:
        nonlocal held
        parts, have = [held], len(held)
        while have < n and (c := next(plain, None)) is not None:
            parts.append(c)
            have += len(c)
        held = b"".join(parts)
        return have >= n

    while True:
        while held.startswith(b"\r\n"):
            held = held[2:]
        at = held.find(b"\r\n\r\n")
        while at < 0 and need(len(held) + 1):
            at = held.find(b"\r\n\r\n")
        if at < 0:
            if held.strip():
                raise ValueError("a record's header ends early")
            return
        head, left = held[:at], at + 4
        left += int(fields(head)["content-length"]) + 4

        def pieces(left=left):
            nonlocal held
            while left:
                if not held and not need(1):
                    raise ValueError("a record ends early")
                now, held = held[:left], held[left:]
                left -= len(now)
                yield now

        yield head, pieces()


def members(plain: Iterator[bytes], index: list[dict], level: int) -> Iterator[bytes]:
    """The records as gzip members; index gets an entry for each."""
    at = 0
    for head, pieces in records(plain):
        z, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for p in pieces:
            if c := z.compress(p):
                size += len(c)
                yield c
        c = z.flush()
        size += len(c)
        yield c
        f = fields(head)
        index.append({"offset": at, "length": size, "type": f.get("warc-type"), "id": f.get("warc-record-id"), "uri": f.get("warc-target-uri")})
        at += size


def normalise_file(source: str, target: str, level: int = 6) -> int:
    """Rewrite one archive; the index goes to target + '.idx' (a JSON object a line).  Gives the number of records."""
    files, path = scratch.open_fs(source)
    index: list[dict] = []
    with files.open_input_stream(path, compression=None) as raw:
        scratch.write_file(target, members(inflated(iter(lambda: raw.read(PIECE), b"")), index, level))
    scratch.write_file(f"{target}.idx", ((json.dumps(x) + "\n").encode() for x in index))
    return len(index)


def read_file(target: str) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """(page_id, payload bytes, payload SHA-1, type, page referred to) of each record, fetched by its index entry."""
    with scratch.open_file(f"{target}.idx") as f:
        index = [json.loads(x) for x in f.read().splitlines()]
    with scratch.open_file(target) as f:
        for x in index:
            f.seek(x["offset"])
            raw = zlib.decompress(f.read(x["length"]), 31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            got = fields(head)
            http, _, payload = rest[: int(got["content-length"])].partition(b"\r\n\r\n")
            size = int(fields(http)["content-length"])
            digest = base64.b32decode(got["warc-payload-digest"].partition(":")[2]).hex()
            refers = _page(got["warc-refers-to"]) if got["warc-type"] == "revisit" else None
            if got["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"{target}: the payload of {got['warc-record-id']} isn't whole")
            yield _page(got["warc-record-id"]), size, digest, got["warc-type"], refers


def with_references(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page that holds the same payload, where another does."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # without the payloads, those of one digest are dealt over SALT parts
    keyed = pages.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= revisit_from)).select("page_id", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"))
    groups = keyed.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    found = keyed.join(groups, ["digest", "salt"]).filter("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    # the page_id spreads rows whose digest is null or frequent
    digest = F.when(F.octet_length("html") >= revisit_from, F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    named = pages.filter("page_id is not null").withColumn("digest", digest).join(found, ["page_id", "digest"], "left")
    return scratch.union(named.select("page_id", "url", "html", "refers_to"), pages.filter("page_id is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))


def write(pages: DataFrame, out: str, level: int = 1) -> list[str]:
    """One monolithic gzip file for each partition of pages (page_id, url, html, refers_to); gives their names."""

    def plain(batches):
        for b in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers)

    def save(batches):
        rows = plain(batches)
        first = next(rows, None)
        if first is None:
            return
        z = zlib.compressobj(level, zlib.DEFLATED, 31)

        def chunks():
            yield z.compress(first)
            for r in rows:
                yield z.compress(r)
            yield z.flush()

        name = f"{out}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        scratch.write_file(name, chunks())
        yield pa.RecordBatch.from_pydict({"file": [name]})

    return sorted(r.file for r in scratch.map_arrow(pages.select("page_id", "url", "html", "refers_to"), save, "file string").collect())


def _each(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "file string").repartition(len(names))


def normalise(spark: SparkSession, names: list[str], out: str, level: int = 6) -> list[str]:
    """Rewrite archives under ``out``, a task for each file; gives the new names."""
    if not names:
        return []

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                target = f"{out}/{name.rpartition('/')[2]}"
                normalise_file(name, target, level)
                yield pa.RecordBatch.from_pydict({"file": [target]})

    return sorted(r.file for r in _each(spark, names).mapInArrow(run, "file string").collect())


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, names: list[str]) -> DataFrame:
    """A row for each record of normalised archives."""
    if not names:
        return spark.createDataFrame([], SCHEMA)

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        labels = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = list(read_file(name))
                for i in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], labels)

    return _each(spark, names).mapInArrow(run, SCHEMA)


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as monolithic archives, normalised and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = scratch.new_dir(spark, "warc")
    whole = write(with_references(pages), f"{out}/whole")
    split = normalise(spark, whole, f"{out}/split", level=4)
    scratch.drop_dir(spark, f"{out}/whole")
    return read(spark, split)


OP4_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages
), g as (select d, max(page_id) as top from p where n >= 1000 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> top then top end as refers_to
from p left join g using (d)
"""
