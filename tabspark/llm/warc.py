"""Deterministic sharded WARC archives.

Records are sorted by range of page_id, so shard k holds no larger ids than shard k + 1.  The borders of
the shards follow from the payload bytes by page_id alone (exact counts over cells of ids, heavy cells
cut again), so the same pages give the same files on any cluster and at any partitioning.  Every task
writes its shard's files under temporary names, rolls to the next file once the compressed size
passes a limit, renames finished files and returns one manifest row per file.  The manifest is a
table of the same folder, written last by Spark's commit protocol: files that it does not list are
leftovers of failed attempts and are ignored.  Records have no clock or random parts, so a repeated
attempt writes the same bytes under the same names.

Records of equal payloads of at least ``min_revisit`` bytes are stored once: the smallest page_id is
the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col_of, saved

DATE = "2000-01-01T00:00:00Z"  # records carry no clock
ROLL_BYTES = 64 << 20  # compressed size at which a file is closed
SHARD_BYTES = 64 << 20  # payload bytes of a shard, about
CELLS = 1 << 12  # into which a range of ids is cut
MIN_REVISIT = 0  # fixed by the contract
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _line(text: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text or "")


def record_id(page_id: int | None, url: str | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {_line(url)} {payload_digest}')}>"


def record(page_id, url, payload: bytes, payload_digest: str, refers_to) -> bytes:
    """One record, uncompressed: WARC headers, HTTP headers, and the payload of a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, payload_digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one uncompressed record; checks its lengths and digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{digest(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError("damaged WARC record")
    http, _, body = block.partition(b"\r\n\r\n")
    sent = dict(line.split(": ", 1) for line in http.decode("ascii").split("\r\n")[1:])
    if headers["WARC-Type"] == "response" and (
        f"sha1:{digest(body)}" != headers["WARC-Payload-Digest"] or len(body) != int(sent["Content-Length"])
    ):
        raise ValueError("damaged WARC payload")
    number = lambda name: int(headers[name]) if headers.get(name) else None
    return {
        "page_id": number("X-Page-Id"),
        "url": headers["WARC-Target-URI"],
        "payload_bytes": int(sent["Content-Length"]),
        "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": headers["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "payload": body if headers["WARC-Type"] == "response" else None,
    }


def _qualified(spark: SparkSession, path: str) -> str:
    """The folder with the file system that Spark takes it to be of."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """A folder as Spark names it; every task opens it by itself."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


class _Shard:
    """The files of one shard: gzip members, one per record, under a temporary name until closed."""

    def __init__(self, path: str, shard: int, roll_bytes: int):
        self.store, self.root = _folder(path)
        self.shard, self.roll_bytes, self.parts, self.out, self.rows = shard, roll_bytes, 0, None, []

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.root}/.tmp-{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self.size, self.count, self.sha, self.first = 0, 0, hashlib.sha256(), page_id
        press = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without name and time
        packed = press.compress(data) + press.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.count += 1
        self.last = page_id
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"part-{self.shard:06d}-{self.parts:05d}.warc.gz"
        self.store.move(self.temporary, f"{self.root}/{name}")
        self.rows.append((name, self.shard, self.parts, self.count, self.size, self.sha.hexdigest(), self.first, self.last))
        self.parts, self.out = self.parts + 1, None


MANIFEST = "name string, shard int, part int, records long, bytes long, sha256 string, first_id long, last_id long"


def payloads(df: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """(page_id, url, payload, sha1) of every row."""
    payload = F.coalesce(col_of(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(col_of(id_col).cast("long").alias("page_id"), col_of(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("sha1", F.sha1("payload"))


def plan_records(rows: DataFrame, keys: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, sha1, tag, refers_to): what the records will hold.

    Rows with tag 1 are the records.  Rows with tag 0 say that the records of one page_id and digest
    refer to another page; they sort before those records.  So payloads are shuffled once, by the
    range sort, and only ids and digests (``keys``) take part in finding the first of equal payloads.
    """
    keys = keys.filter(F.col("bytes") >= min_revisit).select("page_id", "sha1")
    first = keys.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null")
    later = keys.distinct().join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    none = lambda kind: F.lit(None).cast(kind)
    refers = later.select("page_id", none("string").alias("url"), none("binary").alias("payload"), "sha1", F.lit(0).alias("tag"), F.col("first_id").alias("refers_to"))
    return refers.union(rows.select("page_id", "url", "payload", "sha1", F.lit(1).alias("tag"), none("long").alias("refers_to")))


def _cells(keys: DataFrame, low: int, high: int, width: int) -> list[tuple[int, int]]:
    """(first id, bytes) of the filled cells of ``width`` ids, from ``low`` to below ``high``, in order."""
    whole = "decimal(38,0)"  # differences of longs need not be longs
    cell = F.expr(f"cast((cast(page_id AS {whole}) - cast('{low}' AS {whole})) div cast('{width}' AS {whole}) AS bigint)")
    rows = keys.filter(F.col("page_id").between(low, high - 1)).groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"))
    return sorted((low + r["cell"] * width, r["bytes"]) for r in rows.collect())  # at most CELLS rows


def shard_borders(keys: DataFrame, shard_bytes: int = SHARD_BYTES, cells: int = CELLS) -> list[tuple[int | None, int, int]]:
    """(first id, first shard, shards) in order of ids, a null id first, from (page_id, bytes).

    A border's records lie in its shards, those of several in order of the digest: it is a lone id of
    more than ``shard_bytes``.  Shards are filled with whole cells of ids, from the smallest on; a cell
    of more bytes is cut again.  There is about one border per shard.
    """
    ends = keys.agg(
        F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum(F.when(F.col("page_id").isNull(), F.col("bytes"))).alias("none")
    ).first()
    borders = [(None, 0, max(1, -(-(ends["none"] or 0) // shard_bytes)))]
    if ends["low"] is None:
        return borders

    def leaves(low: int, high: int):
        """(first id, bytes) of cells that fit, or hold one id."""
        width = -(-(high - low) // cells)
        for start, size in _cells(keys, low, high, width):
            if size > shard_bytes and width > 1:
                yield from leaves(start, min(high, start + width))
            else:
                yield start, size

    shard, used = borders[0][1] + borders[0][2], None
    for start, size in leaves(ends["low"], ends["high"] + 1):
        if size > shard_bytes:
            shard += used is not None
            n = -(-size // shard_bytes)
            borders.append((start, shard, n))
            shard, used = shard + n, None
        elif used is None or used + size > shard_bytes:
            shard += used is not None
            borders.append((start, shard, 1))
            used = size
        else:
            used += size
    return borders


def _shard_of(borders: list[tuple[int | None, int, int]]) -> Column:
    """The shard of a record, by page_id and sha1."""
    starts = np.array([b[0] for b in borders[1:]], np.int64)
    first, n = (np.array([b[i] for b in borders], np.int64) for i in (1, 2))

    def run(ids: pd.Series, known: pd.Series, heads: pd.Series) -> pd.Series:
        at = np.where(known.to_numpy(bool), np.searchsorted(starts, ids.to_numpy(np.int64), side="right"), 0)
        return pd.Series((first[at] + heads.to_numpy(np.int64) * n[at] // (1 << 28)).astype(np.int32))

    head = F.conv(F.substring("sha1", 1, 7), 16, 10).cast("long")
    return F.pandas_udf(run, "int")(F.coalesce("page_id", F.lit(0).cast("long")), F.col("page_id").isNotNull(), head)


def write_archives(
    df: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, **columns
) -> DataFrame:
    """Write one record per row of ``df`` under ``path`` and return the manifest table.

    Null payloads are empty, null ids and urls are written as empty headers, repeated rows are
    records of their own; an empty table gives an empty manifest.  Ids are integers.  Records of one
    id are spread by their digests; only rows of one id and payload stay together, in files that roll.
    """
    spark = df.sparkSession
    path = _qualified(spark, path)
    rows = payloads(df, **columns)
    keys = saved(rows.select("page_id", "sha1", F.octet_length("payload").cast("long").alias("bytes")), "warc-keys")
    borders = shard_borders(keys, shard_bytes)
    shards = borders[-1][1] + borders[-1][2]
    store, root = _folder(path)
    store.create_dir(root, recursive=True)
    dealt = plan_records(rows, keys, min_revisit).withColumn("shard", _shard_of(borders))
    ordered = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "sha1", "tag", "url")

    def run(batches):
        shard = known = target = None
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, sha1, tag, refers, number = (c[i].as_py() for c in b.columns)
                if shard is None or shard.shard != number:
                    if shard is not None:
                        yield from files(shard)
                    shard, known = _Shard(path, number, roll_bytes), None
                if tag == 0:
                    known, target = (page_id, sha1), refers
                    continue
                of = target if known == (page_id, sha1) else None
                shard.add(page_id, record(page_id, url, payload, digest(payload), of))
        if shard is not None:
            yield from files(shard)

    def files(shard):
        shard.close()
        if shard.rows:
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            cols = [pa.array(c, t) for c, t in zip(zip(*shard.rows), types)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _members(stream, chunk: int = 1 << 20):
    """The gzip members of a stream, one at a time."""
    press, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(press.decompress(data))
        if press.eof:
            yield b"".join(parts)
            data, press, parts = press.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(chunk)
    if any(parts):
        raise ValueError("truncated archive")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the files that the manifest lists, in files' order per task."""
    path = _qualified(spark, path)
    manifest = read_manifest(spark, path).select("name", "records")
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        store, root = _folder(path)
        for b in batches:
            for name, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, n = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        r = parse_record(data)
                        rows.append([r[k] for k in names])
                        n += 1
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if n != expected:
                    raise ValueError(f"{name}: {n} records, the manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # One file a task at most: files are independent and of bounded size.
    spread = manifest.repartition(max(1, manifest.count()), "name")
    return spread.mapInArrow(run, RECORDS + ", payload binary" * with_payload)
