"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas.  A batch of events is
folded per document and tokenizer against the committed ledger: inserts add, a revised count
replaces the old one, a delete takes out what is there.  What changed becomes signed rows: the
batch's ledger part, and its partial totals.

A batch is written to a folder of its own attempt and takes effect through one commit file that
names the attempt.  The file is filled under a temporary name and then renamed, never over another,
so it is whole or absent: a repeated batch changes nothing and a failed attempt leaves only unread
files.  Batches are committed one after the other (one writer).

The ledger lies in folders by hash of the document, and a batch reads only those of its own documents.
``compact`` folds the batches so far into one snapshot; what it covers is no longer read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, col_of, in_bitmap, words_of
from .tokenize import default_path, tokens

KEY = ("doc_id", "source", "lang", "tokenizer")
GROUP = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, bucket int"
BUCKETS = 64  # folders of a ledger part
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def counted(df: DataFrame, tokenizers: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every row and tokenizer version.

    ``tokenizers``: version name -> tokenizer file, or "words" / "space" for the words of the
    contracts and for white-space runs.  Null and empty texts have no tokens; ids are integers.
    """
    rows = df.select(
        col_of(id_col).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), col_of(text_col).cast("string").alias("text")
    )

    def size(kind: str, text: str) -> int:
        return len(text.split()) if kind == "space" else len(words_of(text)) if kind == "words" else len(tokens(kind).ids(text))

    def run(batches):
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(3)]
            for name, kind in tokenizers.items():
                n = pa.array([size(kind, t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array([name] * len(texts), pa.string()), n], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"]
                )

    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


class TokenRollup:
    """Totals under one folder of a file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _list(self, part: str) -> dict[str, list[str]]:
        """The lines of every finished file of a folder, by its name."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = make(f"{self.path}/{part}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = {}
        for entry in fs.listStatus(folder) if fs.exists(folder) else ():
            name = entry.getPath().getName()
            if name.startswith("."):  # not renamed: of a lost attempt
                continue
            stream = fs.open(entry.getPath())
            try:
                out[name] = bytes(stream.readAllBytes()).decode().split("\n")
            finally:
                stream.close()
        return out

    def _publish(self, part: str, name: str, lines: list[str]) -> None:
        """Make a file visible whole; fails if there is one of that name."""
        java = self.spark._jvm.org.apache.hadoop.fs
        folder = java.Path(f"{self.path}/{part}")
        conf = self.spark._jsc.hadoopConfiguration()
        fs = folder.getFileSystem(conf)
        temporary = java.Path(folder, f".{name}-{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray("\n".join(lines).encode()))
        finally:
            out.close()
        keep = getattr(java, "Options$Rename").NONE
        how = self.spark.sparkContext._gateway.new_array(getattr(java, "Options$Rename"), 1)
        how[0] = keep
        java.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(temporary), fs.makeQualified(java.Path(folder, name)), how)

    def committed(self) -> dict[str, str]:
        """Attempt folder by batch id."""
        return dict(lines for lines in self._list("commits").values())

    def _attempts(self) -> list[str]:
        """The attempts to read: the newest snapshot, and the batches that it does not cover."""
        attempts, snapshots = set(self.committed().values()), self._list("snapshots")
        if snapshots:
            own, *covered = snapshots[max(snapshots)]
            attempts = attempts.difference(covered) | {own}
        return sorted(attempts)

    def _read(self, part: str, schema: str) -> DataFrame:
        rows = self.spark.createDataFrame([], schema)
        for a in self._attempts():
            rows = rows.union(self.spark.read.schema(schema).parquet(f"{self.path}/attempts/{a}/{part}"))
        return rows

    def _write(self, attempt: str, ledger: DataFrame) -> None:
        """The parts of an attempt; the folders of a ledger are split and merged to files of good size."""
        root = f"{self.path}/attempts/{attempt}"
        ledger.withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/ledger")
        rows = self.spark.read.schema(LEDGER).parquet(f"{root}/ledger")
        rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{root}/totals")

    def compact(self) -> None:
        """Fold the batches so far into one snapshot; nothing changes in what the rollup says."""
        covered, attempt = sorted(self.committed().values()), uuid.uuid4().hex
        self._write(attempt, self.ledger())
        self._publish("snapshots", f"{len(covered):012d}-{attempt}", [attempt, *covered])

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """Current documents and tokens by document and tokenizer, of all folders or the given ones."""
        rows = self._read("ledger", LEDGER)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        now = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return now.filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """Sums of the committed batches' partial totals; groups without documents do not show."""
        parts = self._read("totals", TOTALS)
        now = parts.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return now.filter("docs <> 0 or tokens <> 0")

    def deltas(self, events: DataFrame) -> DataFrame:
        """Signed ledger rows of a batch.

        ``events``: op (insert, revise, delete), the key columns, n_tokens.  Within a batch inserts
        come first, then the revision (the largest of several), then the delete.  Every insert is a
        document of its own, also when repeated; a revision holds for all documents of the key;
        revisions and deletes of unknown keys do nothing; a null count is zero; an unknown op fails.
        """
        e = events.select("op", *KEY, F.coalesce("n_tokens", F.lit(0)).alias("n"))
        good = F.when(F.col("op").isin("insert", "revise", "delete"), F.col("op"))
        e = e.withColumn("op", F.coalesce(good, F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("string")))
        zero, is_ = F.lit(0).cast("long"), lambda op: F.col("op") == op
        new = e.select(
            *KEY,
            zero.alias("d0"),
            zero.alias("t0"),
            F.when(is_("insert"), 1).otherwise(0).cast("long").alias("d1"),
            F.when(is_("insert"), F.col("n")).otherwise(0).cast("long").alias("t1"),
            F.when(is_("revise"), F.col("n")).cast("long").alias("rev"),
            is_("delete").cast("int").alias("del"),
        )
        buckets = sorted(r[0] for r in e.select(_bucket()).distinct().collect())  # at most BUCKETS
        old = self.ledger(buckets)
        mine = e.select(F.xxhash64("doc_id"))
        old = old.filter(in_bitmap(bitmap(mine), F.xxhash64("doc_id")))  # before the shuffle
        old = old.select(*KEY, F.col("docs").alias("d0"), F.col("tokens").alias("t0"), zero.alias("d1"), zero.alias("t1"), F.lit(None).cast("long").alias("rev"), F.lit(0).alias("del"))
        # One shuffle by key: the ledger and the events meet in one aggregate, inserts summed before it.
        folded = old.union(new).groupBy(*KEY).agg(
            F.sum("d0").alias("d0"), F.sum("t0").alias("t0"), F.sum("d1").alias("d1"), F.sum("t1").alias("t1"), F.max("rev").alias("rev"), F.max("del").alias("del")
        )
        docs = F.col("d0") + F.col("d1")
        counted = F.when(F.col("rev").isNotNull(), docs * F.col("rev")).otherwise(F.col("t0") + F.col("t1"))
        gone = F.col("del") == 1
        changed = folded.select(
            *KEY,
            (F.when(gone, 0).otherwise(docs) - F.col("d0")).alias("docs"),
            (F.when(gone, 0).otherwise(counted) - F.col("t0")).alias("tokens"),
        )
        return changed.filter("docs <> 0 or tokens <> 0")

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Apply a batch once; False (and no change) if that batch is already committed."""
        if "\n" in batch_id or not batch_id:
            raise ValueError("a batch id is one line of text")
        if batch_id in self.committed():
            return False
        attempt = uuid.uuid4().hex
        self._write(attempt, self.deltas(events))
        try:
            self._publish("commits", uuid.uuid5(uuid.NAMESPACE_OID, batch_id).hex, [batch_id, attempt])
        except Exception:  # another attempt may have been first
            if batch_id in self.committed():
                return False
            raise
        return True


def default_versions() -> dict[str, str]:
    return {"byte_bpe_50k": default_path(), "space_v1": "space"}
