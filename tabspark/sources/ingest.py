"""Ingest CSV / Parquet into an immutable canonical Parquet version.

``ingest`` reads the source with Spark's readers (CSV: the dialect is found
from the head of the file, then schema inference + FAILFAST, so a malformed
row fails the job), normalizes the types to the logical type system (integers -> bigint, timestamps without
zone), mints stable column ids into the field metadata and writes the
canonical copy with ``errorifexists``: an existing target is never
touched.  Spark's commit protocol only publishes the target when every
task succeeded.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DatasetSchema, attach, col_of
from .dialect import read_csv, sniff

SOURCE_FORMATS = ("csv", "parquet")


class IngestionError(ValueError):
    pass


def source_format(path: str) -> str:
    """Format from the file suffix (``.csv`` / ``.parquet``), else an error."""
    lowered = path.rstrip("/").lower()
    if ".." in path.replace("\\", "/").split("/"):
        raise IngestionError("source path must not contain '..'")
    for fmt in SOURCE_FORMATS:
        if lowered.endswith(f".{fmt}"):
            return fmt
    raise IngestionError(f"unsupported source format: {path}")


def read_source(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    delimiter: str | None = None,
    header: bool | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read a CSV or Parquet source with the strict options.

    What is not given of a CSV's dialect is found from its head (``dialect.sniff``).  A file with
    line breaks in quoted fields cannot be split; breaks that only occur beyond the head need
    ``multi_line=True``.
    """
    fmt = fmt or source_format(path)
    if fmt == "csv":
        found = sniff(spark, path, delimiter)
        given = {"header": header, "multi_line": multi_line}
        return read_csv(spark, path, replace(found, **{k: v for k, v in given.items() if v is not None}))
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise IngestionError(f"unsupported source format: {fmt}")


def normalize_types(df: DataFrame) -> DataFrame:
    """Integers become bigint and zoned timestamps become local timestamps."""
    cols = []
    for f in df.schema.fields:
        c = col_of(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


@dataclass(frozen=True)
class Manifest:
    source_format: str
    canonical_format: str
    row_count: int
    byte_size: int
    schema: DatasetSchema

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.source_format, self.canonical_format, self.row_count, self.byte_size, len(self.schema.columns))],
            "source_format string, canonical_format string, row_count bigint, byte_size bigint, column_count int",
        )


def byte_size(spark: SparkSession, path: str) -> int:
    """Total bytes of the data files of a Parquet directory (from file metadata)."""
    sizes = (
        spark.read.parquet(path)
        .select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
        .distinct()
        .agg(F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"))
        .first()
    )
    return int(sizes["bytes"])


def write_canonical(df: DataFrame, target: str, compression: str = "zstd") -> None:
    """Write once; an existing target raises and is left untouched.

    The data goes to a folder of this attempt and is renamed when complete, so a failed write
    leaves no target behind and can simply be repeated.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        raise IngestionError(f"canonical target already exists: {target}")
    attempt = f"{target.rstrip('/')}.attempt-{uuid.uuid4().hex}"
    try:
        df.write.mode("errorifexists").option("compression", compression).parquet(attempt)
        if fs.exists(path(target)) or not fs.rename(path(attempt), path(target)):
            raise IngestionError(f"canonical target already exists: {target}")
    except Exception:
        fs.delete(path(attempt), True)
        raise


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str | None = None,
    delimiter: str | None = None,
    header: bool | None = None,
    multi_line: bool | None = None,
) -> tuple[DataFrame, Manifest]:
    """Source file -> canonical Parquet + manifest; returns the canonical frame."""
    fmt = fmt or source_format(source)
    if os.path.abspath(source) == os.path.abspath(target):
        raise IngestionError("the canonical copy needs a path of its own")
    try:
        raw = normalize_types(read_source(spark, source, fmt, delimiter, header, multi_line))
    except AnalysisException as exc:
        raise IngestionError(f"source file does not exist or is unreadable: {source}") from exc
    schema = DatasetSchema.of(raw, mint_ids=True)
    write_canonical(attach(raw, schema), target)
    canonical = spark.read.parquet(target)
    manifest = Manifest(
        source_format=fmt,
        canonical_format="parquet",
        row_count=canonical.count(),
        byte_size=byte_size(spark, target),
        schema=DatasetSchema.of(canonical),
    )
    return canonical, manifest


def export_csv(df: DataFrame, target: str, schema: DatasetSchema | None = None) -> None:
    """CSV with a header of display names, in column order.

    Times keep their microseconds, quotes are doubled, spaces and line breaks stay as they are.  An
    empty text is written as "" and, like an empty field, read back as NULL.
    """
    schema = schema or DatasetSchema.of(df)
    out = df.select(*[col_of(c.physical_name).alias(c.display_name) for c in schema.columns])
    (
        out.write.mode("errorifexists")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .csv(target)
    )


def export_parquet(canonical_path: str) -> str:
    """The canonical Parquet artifact is already the export; return its path."""
    return canonical_path
