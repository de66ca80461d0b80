"""Numbered records that are published once each, whoever tries: compare-and-swap on a shared file system."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with the text unless there is one at `path`; whether this call made it. Readers see all of it or nothing.

    The text is written beside it under a hidden name and then moved there, which fails if another was faster: by a hard link on local file systems, by
    a rename without overwriting elsewhere. An object store must give renames, or an implementation of them, that property.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return bool(fs.rename(draft, target))
        local = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
        jvm.java.nio.file.Files.createLink(local(target), local(draft))
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def publish(spark: SparkSession, folder: str, number: int, record: dict) -> bool:
    """Publishes record `number`; False if that number is taken."""
    return create(spark, f"{folder}/{number:012d}.json", json.dumps(record, sort_keys=True))


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def newest(spark: SparkSession, folder: str, schema: str, number: str):
    """The record with the largest number, None without any."""
    try:
        rows = records(spark, folder, schema)
    except AnalysisException:  # nothing there yet
        return None
    return rows.groupBy().agg(F.max_by(F.struct(*rows.columns), number).alias("r")).first()["r"]
