"""op12: Merkle manifest of the whole documents table; every seventh id hash is checked tampered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col_of, crc_mod, table
from .merkle import COLUMNS, folded, leaf_digest, proof_digest, proofs


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = [col_of(c) + 1 if c == "n_chars" else col_of(c) for c in COLUMNS]
    tampered = F.when(crc_mod(F.col("doc_id"), 7) == 0, leaf_digest(values))
    rows = proofs(docs, carry={"tampered": tampered})
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


_LEAF = " || ".join(_field(c) for c in COLUMNS)
_TAMPERED = " || ".join(_field("(n_chars + 1)" if c == "n_chars" else c) for c in COLUMNS)
# crc32 bit by bit (reversed polynomial 0xEDB88320), as SQL has no such function.
_STEP = "xor(c >> 1, 3988292384 * (c & 1))"
_CRC = (
    "xor(list_reduce([unicode(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], "
    f"lambda a, b: list_reduce(range(8), lambda c, i: {_STEP}, xor(a, b)), 4294967295::BIGINT), 4294967295)"
)
OP12_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, sha256({_LEAF}) AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN sha256({_TAMPERED}) END AS tampered
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT 0 AS lev, lang, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT any_value(lev) + 1, lang, pos // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lang, pos // 2),
nodes AS MATERIALIZED (SELECT * FROM tree),
tops AS MATERIALIZED (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
toptree AS (
  SELECT 0 AS lev, pos, n, subroot AS d FROM tops
  UNION ALL
  SELECT any_value(lev) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY pos)) FROM toptree WHERE n > 1 GROUP BY pos // 2),
topnodes AS MATERIALIZED (SELECT * FROM toptree),
fold AS (
  SELECT 0 AS lev, rid, lang, pos, n, coalesce(tampered, leaf) AS d, '' AS proof FROM placed
  UNION ALL
  SELECT f.lev + 1, f.rid, f.lang, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN s.d || f.d ELSE f.d || coalesce(s.d, '') END), f.proof || coalesce(s.d, '')
  FROM fold f LEFT JOIN nodes s ON s.lev = f.lev AND s.lang IS NOT DISTINCT FROM f.lang AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
mid AS MATERIALIZED (
  SELECT rid, f.d, f.proof, t.pos, t.n, t.subroot FROM fold f JOIN tops t ON t.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1),
topfold AS (
  SELECT 0 AS lev, rid, pos, n, d, proof, subroot FROM mid
  UNION ALL
  SELECT f.lev + 1, rid, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN s.d || f.d ELSE f.d || coalesce(s.d, '') END), proof || coalesce(s.d, ''), subroot
  FROM topfold f LEFT JOIN topnodes s ON s.lev = f.lev AND s.pos = xor(f.pos, 1) WHERE f.n > 1)
SELECT p.doc_id, p.leaf, t.subroot, r.d AS root, sha256(t.proof) AS proof_sha256, t.d AS folded_root, t.d = r.d AS verified
FROM topfold t JOIN placed p USING (rid), (SELECT d FROM topnodes WHERE n = 1) r WHERE t.n = 1
"""

QUERIES = {"op12_merkle": op12_merkle}
ORACLE = {"op12_merkle": OP12_SQL}
