import gzip
import os

import pytest
from pyspark.sql import functions as F

from tabspark.llm import warc as W


def pages(spark):
    rows = [(i, f"http://h/{i % 3}", f"<p>{i // 4} é {'x' * (i * 37 % 900)}</p>" if i % 2 else "<same>") for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nInjected: 1", ""), (None, "n", "<same>"), (7, "again", "<p>1 é </p>"), (102, "big", "y" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "sha1": F.lit("s"), "refers_to": F.lit(0)})


def test_round_trip(spark, scratch):
    df = pages(spark)
    path = f"file://{scratch}/a"
    manifest = W.write_archives(df, path, shard_bytes=5000, roll_bytes=700)
    got = [r.asDict() for r in W.read_archives(spark, path, with_payload=True).collect()]
    src = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    first = {}
    for p, h in src:
        if p is not None:
            first[h] = min(first.get(h, p), p)
    assert len(got) == len(src) == sum(r.records for r in manifest.collect())
    want = sorted((str(p), len(h), W.digest(h), "response" if p == first.get(h) else "revisit", str(None if p == first[h] else first[h])) for p, h in src)
    assert sorted((str(g["page_id"]), g["payload_bytes"], g["payload_digest"], g["record_type"], str(g["refers_to"])) for g in got) == want
    assert all(bytes(g["payload"]) in {h for _, h in src} for g in got if g["record_type"] == "response")
    assert any(g["url"] == "u%0D%0AInjected: 1" for g in got)
    files = {r.name: r for r in manifest.collect()}
    assert len(files) > 3 and max(r.part for r in files.values()) > 0
    ranges = sorted((r.shard, r.part, r.first_id or -1, r.last_id or -1) for r in files.values())
    assert all(a[3] <= b[2] for a, b in zip(ranges, ranges[1:]))
    raw = b"".join(gzip.open(f"{scratch}/a/{n}").read() for n in files)
    assert raw.count(b"WARC/1.1\r\n") == len(src)


def test_same_bytes_again_and_leftovers_ignored(spark, scratch):
    df = pages(spark)
    sha = lambda d, p: sorted((r.name, r.sha256) for r in W.write_archives(d, p, shard_bytes=4000, roll_bytes=2000).collect())
    first = sha(df, f"{scratch}/a")
    assert len({n.split("-")[1] for n, _ in first}) > 3
    assert first == sha(df.repartition(7), f"{scratch}/b") == sha(df.orderBy(F.rand(1)).coalesce(1), f"{scratch}/c")
    with open(f"{scratch}/a/part-000009-00000.warc.gz", "wb") as f:
        f.write(b"from a failed attempt")
    assert W.read_archives(spark, f"{scratch}/a").count() == df.count()
    assert not [n for n in os.listdir(f"{scratch}/a") if n.startswith(".tmp")]


def test_damage_is_noticed():
    data = W.record(1, "u", b"abc", W.digest(b"abc"), None)
    assert W.parse_record(data)["payload"] == b"abc"
    with pytest.raises(ValueError):
        W.parse_record(data.replace(b"abc", b"abd"))


def test_small_payloads_and_empty_table(spark, scratch):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    W.write_archives(df, f"{scratch}/a", min_revisit=3)
    assert {r.page_id: r.record_type for r in W.read_archives(spark, f"{scratch}/a").collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    W.write_archives(df.filter("page_id < 0"), f"{scratch}/b")
    assert W.read_archives(spark, f"{scratch}/b").count() == 0


def test_borders_hold_ids_and_bytes(spark, scratch):
    top = 2**63 - 1
    ids = [None] * 40 + [5] * 50 + list(range(1000, 1100)) + [-top - 1, top, top - 1]
    df = spark.createDataFrame([(p, f"u{i}", f"{i:0100d}") for i, p in enumerate(ids)], "page_id long, url string, html string")
    manifest = W.write_archives(df, f"{scratch}/a", shard_bytes=1000).collect()
    assert max(r.records for r in manifest) <= 25  # ten records a shard; a hot id's are spread by digest
    assert sorted(map(str, ids)) == sorted(str(r.page_id) for r in W.read_archives(spark, f"{scratch}/a").collect())
    order = sorted((r.shard, r.part, r.first_id, r.last_id) for r in manifest if r.first_id is not None)
    assert all(a[3] <= b[2] for a, b in zip(order, order[1:]))
    keys = df.selectExpr("page_id", "100L AS bytes")
    assert W.shard_borders(keys, 1000, cells=4) == W.shard_borders(keys.repartition(5), 1000, cells=4)
    assert W.shard_borders(keys.filter("false"), 1000) == [(None, 0, 1)]
