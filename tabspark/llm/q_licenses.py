"""op9: licence scan of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .licenses import all_templates, scan


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same templates, held against every position."""
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(f"({k}, '{t.label}', {lists(t.phrase)}, {lists(t.words)}, {t.at}, {str(t.base).lower()})" for k, t in enumerate(all_templates()))
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t(k, label, phrase, words, phrase_at, base) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
vocab AS (SELECT DISTINCT unnest(words) AS word FROM t),
df AS (SELECT word, count(rid) AS df FROM vocab LEFT JOIN (SELECT DISTINCT rid, unnest(w) AS word FROM docs) USING (word) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df),
tw AS (SELECT k, idf, i - 1 AS i, word FROM (SELECT k, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM t) JOIN idf USING (word)),
pos AS (SELECT rid, w, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
found AS (SELECT rid, k, label, base, p, p - phrase_at AS first_at, w FROM pos JOIN t ON pos.word = t.phrase[1] AND w[p + 1:p + len(phrase)] = phrase),
scored AS (
  SELECT rid, f.k, label, base, p, sum(CASE WHEN first_at + i >= 0 AND first_at + i < len(w) AND w[first_at + i + 1] = tw.word THEN idf ELSE 0 END) / sum(idf) AS s
  FROM found f JOIN tw ON f.k = tw.k GROUP BY rid, f.k, label, base, p),
by_doc AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(s) AS score
  FROM scored GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6)::DOUBLE AS score
FROM docs LEFT JOIN by_doc USING (rid)
"""


QUERIES = {"op9_licenses": op9_licenses}
ORACLE = {"op9_licenses": _sql()}
