"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

# Words: runs of letters, digits and every character beyond ASCII (a fixed value of the contracts).
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(WORD_PATTERN)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col_of(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back.

    Cuts the lineage: later stages survive lost executors without recomputing what came before.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


def ascii_lower_col(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_col(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.coalesce(
        F.regexp_extract_all(ascii_lower_col(text), F.lit(WORD_PATTERN), F.lit(0)),
        F.array().cast("array<string>"),
    )


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def slices(n: int, size: int) -> Iterator[slice]:
    for start in range(0, n, size):
        yield slice(start, min(n, start + size))


BITS = 1 << 20  # of a bitmap of hashes; a fuller one only lets more rows through


def bitmap(hashes: DataFrame, bits: int = BITS) -> Column:
    """The hashes of a one-column table as an array of ``bits`` bits, whatever their number."""
    h = F.pmod(col_of(hashes.columns[0]), F.lit(bits))
    rows = hashes.select(h.alias("h")).selectExpr("shiftright(h, 6) AS at", "shiftleft(1L, cast(h % 64 AS int)) AS bit")
    words = [0] * (bits // 64)  # at most so many rows
    for r in rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        words[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def in_bitmap(words: Column, value: Column, bits: int = BITS) -> Column:
    """Whether a hash may be in the bitmap; one that is in it always is."""
    h = F.pmod(value, F.lit(bits))
    return F.getbit(F.get(words, F.call_function("shiftright", h, F.lit(6)).cast("int")), (h % 64).cast("int")) == 1


def kept_rows(df: DataFrame, keys: list[Column], others: DataFrame, how: str) -> DataFrame:
    """The rows of ``df`` whose keys are (``left_semi``) or are not (``left_anti``) rows of ``others``.

    Always a shuffled join, nulls equal; the columns of ``df`` may have any names.
    """
    packed = df.select(F.struct("*").alias("row"), *(k.alias(f"left_{i}") for i, k in enumerate(keys)))
    right = others.toDF(*(f"right_{i}" for i in range(len(keys)))).hint("merge")
    same = [F.col(f"left_{i}").eqNullSafe(F.col(f"right_{i}")) for i in range(len(keys))]
    return packed.join(right, same, how).select("row.*")
