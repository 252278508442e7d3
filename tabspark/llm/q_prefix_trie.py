"""op11: trie of shared prefixes over the whole conversations table, rebuilt from their bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, saved, table
from .prefix_trie import prefix_trie, sequences

BASES, HEADS = 100, 6  # fixed by the contract


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation begins with the first turns of the base of its hundred."""
    head = crc_mod(F.col("conv_id"), HEADS).cast("int")
    own = seqs.select("conv_id", "turns", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASES).alias("base"))
    bases = seqs.filter(F.col("conv_id") % BASES == 0).select(F.col("conv_id").alias("_id"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    empty = F.filter("turns", lambda t: F.lit(False))
    first = F.slice(F.coalesce("_head", empty), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(bases, F.col("base") == F.col("_id"), "left").select("conv_id", F.concat(first, rest).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(saved(sequences(table(spark, sf_dir, "conversations")), "trie-turns")))


# crc32 bit by bit (reversed polynomial 0xEDB88320), as SQL has no such function.
_CRC = (
    "xor(list_reduce([unicode(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')], "
    "lambda a, b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295)"
)
OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, md5(strlen(r)::VARCHAR || ':' || r || x) AS k, length(x) AS n FROM t),
c AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS own, {_CRC} % 6 AS h FROM k GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS p
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
m AS (
  SELECT conv_id, len(p) AS size, d, array_to_string([x.k FOR x IN p[1:d]], '') AS path, coalesce(p[d].n, 0) AS n
  FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM r)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM m GROUP BY path, d),
kids AS (SELECT path[1:32 * (d - 1)] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
up AS (
  SELECT path[1:32 * a] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT path, n_children, own, unnest(range(0, d + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
  up.n_leaves::BIGINT AS n_leaves, up.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN up USING (path) LEFT JOIN nodes q ON v.d > 0 AND q.path = v.path[1:32 * (v.d - 1)]
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE = {"op11_prefix_trie": OP11_SQL}
