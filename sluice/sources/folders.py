"""Folders that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder's URI below the one that the cluster names in spark.checkpoint.dir.

    Only a session of one machine that names none gets a temporary one.
    """
    found = spark.conf.get(KEY, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{KEY} has to name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        spark.conf.set(KEY, found)
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, uri: str) -> None:
    """Removes a folder, if it is there."""
    files, path = _path(spark, uri)
    files.delete(path, True)


def read_text(spark: SparkSession, uri: str) -> str | None:
    """A small file's text, None where there is no such file."""
    files, path = _path(spark, uri)
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    files, path = _path(spark, uri)
    stream = files.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
