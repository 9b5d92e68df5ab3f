"""Small JSON files that appear whole or not at all."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The path, and its file system, as the session's own Hadoop objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_mark(spark: SparkSession, path: str) -> dict | None:
    """What :func:`write_mark` wrote there; None where nothing is."""
    target, files = _file(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_mark(spark: SparkSession, path: str, content: dict) -> None:
    """Write beside ``path`` and rename; refused where a file is already."""
    target, files = _file(spark, path)
    partial, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(partial)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True), "utf-8"))
    finally:
        stream.close()
    if files.exists(target) or not files.rename(partial, target):
        files.delete(partial, False)
        raise FileExistsError(path)


def remove_mark(spark: SparkSession, path: str) -> None:
    target, files = _file(spark, path)
    files.delete(target, False)
