"""What several drivers write at a time: claims, and rows appended to a shared table.

A claim is filled under a temporary name and then takes its own name unless that is taken, so it is
whole or absent and the first writer wins.  On a local file system this is a hard link, elsewhere a
rename without overwriting (atomic on HDFS and on object stores with conditional writes).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _open(spark: SparkSession, folder: str, name: str):
    java, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = java.Path(folder, name)
    return java, conf, path.getFileSystem(conf), path


def read_claim(spark: SparkSession, folder: str, name: str) -> str | None:
    """The text of a claim; None if nobody made it."""
    _, _, fs, path = _open(spark, folder, name)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def claim(spark: SparkSession, folder: str, name: str, text: str) -> str:
    """Claim ``name`` with ``text``; returns the text that holds it: the own one, or an earlier writer's."""
    java, conf, fs, path = _open(spark, folder, name)
    held = read_claim(spark, folder, name)
    if held is not None:
        return held
    temporary = java.Path(folder, f".{name}-{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    source, target = fs.makeQualified(temporary), fs.makeQualified(path)
    try:
        if source.toUri().getScheme() == "file":
            local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(local(target), local(source))
        else:
            rename = getattr(java, "Options$Rename")
            how = spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.NONE
            java.FileContext.getFileContext(fs.getUri(), conf).rename(source, target, how)
    except Py4JJavaError:
        held = read_claim(spark, folder, name)
        if held is None:
            raise
        return held
    finally:
        if fs.exists(source):
            fs.delete(source, False)
    return text


def append_rows(rows: DataFrame, path: str) -> None:
    """Append a few rows to a Parquet table as one file, written aside and then moved in.

    Jobs that append to one folder share its temporary folder and would remove each other's files.
    """
    spark, aside = rows.sparkSession, f"{path}-staging/{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(aside)
    java, _, fs, target = _open(spark, path, "part")
    fs.mkdirs(target.getParent())
    for entry in fs.globStatus(java.Path(aside, "part-*")):
        if not fs.rename(entry.getPath(), java.Path(path, entry.getPath().getName())):
            raise OSError(f"cannot move {entry.getPath()} to {path}")
