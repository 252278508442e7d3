"""op5: the whole pages table as WARC archives, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import work_dir
from .common import table
from .warc import read_archives, write_archives


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base32 by five bits at a time out of the digest's hex digits.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS f, count(*) OVER (PARTITION BY sha1(h)) AS k FROM p),
b AS (SELECT *, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (position(substr(x, i, 1) IN '0123456789abcdef') - 1) + 1, 4) FOR i IN range(1, 41)], '') AS bits FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * substr(bits, 5 * j + 1, 1)::INT + 8 * substr(bits, 5 * j + 2, 1)::INT + 4 * substr(bits, 5 * j + 3, 1)::INT
    + 2 * substr(bits, 5 * j + 4, 1)::INT + substr(bits, 5 * j + 5, 1)::INT, 1) FOR j IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM b
"""

QUERIES = {"op5_warc": op5_warc}
ORACLE = {"op5_warc": OP5_SQL}
