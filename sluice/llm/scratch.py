"""Shared storage for cut lineage and for operators that write files.

The folder is the one that the cluster names in ``spark.checkpoint.dir``; only in a session of one machine (tests, a
laptop) that leaves it unset a temporary folder is made.  Files are reached through pyarrow's file systems, so any URI
that they know will do.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
#: Bytes in an Arrow batch, about.
BATCH_BYTES = 4 << 20
#: Narrow rows in a file of a counted table, about.
FILE_ROWS = 50_000
#: Rows of one id each that a broadcast may hold.
BROADCAST_IDS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI.  A cluster has to name one: its machines don't see each other's temporary folders."""
    found = spark.conf.get(KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"{KEY} has to name a folder that all machines of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder's URI below the shared one."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    rows: at most so many rows come, known from counting; a small table then isn't spread over many small files.
    """
    path = new_dir(df.sparkSession, tag)
    if rows is not None and rows < FILE_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove the tables behind materialized DataFrames that nothing reads any more."""
    for df in frames:
        if folder := df.__dict__.get("_folder"):
            drop_dir(df.sparkSession, folder)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, changed where a table has a column of that name (whatever its case)."""
    have = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def without(docs: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """docs less the rows whose doc_id is in ids (doc_id), which are written first.

    So what makes ids doesn't run beside the join's shuffle.  Up to BROADCAST_IDS of them, as counted, are broadcast;
    beyond, Spark joins as the written table's size tells it.
    """
    ids = materialize(ids.select("doc_id").distinct(), tag)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow over batches of about BATCH_BYTES, however long the rows are (a longer row stands alone).

    Spark counts rows only by default; the limit is set for the session, as it is read when the plan is made.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def union(*frames: DataFrame) -> DataFrame:
    """UNION ALL by position.

    Spark 4.1 takes a union's rows as partitioned if its inputs' are, though adaptive execution may have coalesced the
    inputs differently; an aggregate or join above then splits keys.  That setting is switched off for the session.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionAll, frames)


def drop_dir(spark: SparkSession, uri: str) -> None:
    """Remove a folder of ours."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """pyarrow file system and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{os.path.abspath(uri)}")


def write_file(uri: str, chunks) -> int:
    """Write the chunks to a temporary name and move it into place: a retried or doubled task leaves one whole file."""
    files, path = open_fs(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    total = 0
    with files.open_output_stream(part, compression=None) as out:
        for c in chunks:
            out.write(c)
            total += len(c)
    files.move(part, path)
    return total


def open_file(uri: str):
    """An input file with random access."""
    files, path = open_fs(uri)
    return files.open_input_file(path)


def exists(uri: str) -> bool:
    """Whether there is a file of that name."""
    files, path = open_fs(uri)
    return files.get_file_info(path).is_file


def drop_file(uri: str) -> None:
    """Remove a file of ours, if nothing else has."""
    files, path = open_fs(uri)
    try:
        files.delete_file(path)
    except FileNotFoundError:
        pass
