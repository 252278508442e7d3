import os

import pytest
from pyspark.sql import functions as F

from tabspark.operators import explore as X
from tabspark.operators import prepare as P
from tabspark.sources import ingest as I
from tabspark.sources.versions import RESULT_ROWS_SCHEMA, Catalog, VersionError

WEATHER = """station.id,reading,"note, long",seen
7,3.25,"calm ""blue"" sky",2021-05-01T10:00:00.123456
8,,"wind, rain",2021-05-02T11:30:00.000001
9,-1.5,,2021-05-03T00:00:00
"""


def put(scratch, name, text):
    path = os.path.join(scratch, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_types_quotes_and_names(spark, scratch):
    df, manifest = I.ingest(spark, put(scratch, "w.csv", WEATHER), f"{scratch}/out")
    assert [(c.physical_name, c.data_type) for c in manifest.schema.columns] == [
        ("station.id", "integer"), ("reading", "float"), ("note, long", "string"), ("seen", "datetime")
    ]
    rows = [tuple(r) for r in df.orderBy("`station.id`").collect()]
    assert rows[0][:3] == (7, 3.25, 'calm "blue" sky') and rows[1][:3] == (8, None, "wind, rain") and rows[2][2] is None
    assert rows[0][3].microsecond == 123456 and manifest.row_count == 3 and manifest.byte_size > 0
    assert len({c.column_id for c in manifest.schema.columns}) == 4


def test_line_breaks_need_multi_line(spark, scratch):
    src = put(scratch, "m.csv", 'k,t\n1,"two\nlines"\n2,"p, ""q"", r"\n')
    df, _ = I.ingest(spark, src, f"{scratch}/m", multi_line=True)
    assert sorted(map(tuple, df.collect())) == [(1, "two\nlines"), (2, 'p, "q", r')]


def test_csv_export_round_trip(spark, scratch):
    df = spark.createDataFrame([(1, ' a "b" ', None), (2, "x\ny,z", 1.5), (3, None, -2.0)], "`k.id` long, t string, v double")
    df = df.withColumn("at", F.lit("2020-01-02 03:04:05.000007").cast("timestamp_ntz"))
    I.export_csv(df, f"{scratch}/e.csv")
    back = I.normalize_types(I.read_source(spark, f"{scratch}/e.csv", "csv", multi_line=True))
    assert back.columns == df.columns
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_target_is_never_touched(spark, scratch):
    src = f"{scratch}/src.parquet"
    spark.range(4).selectExpr("id % 2 = 0 even", "id").write.parquet(src)
    _, manifest = I.ingest(spark, src, f"{scratch}/canon")
    assert [c.data_type for c in manifest.schema.columns] == ["boolean", "integer"]
    before = sorted(os.listdir(f"{scratch}/canon"))
    with pytest.raises(I.IngestionError, match="already exists"):
        I.ingest(spark, src, f"{scratch}/canon")
    assert sorted(os.listdir(f"{scratch}/canon")) == before
    for bad in ("table.xlsx", "../up.csv"):
        with pytest.raises(I.IngestionError):
            I.source_format(bad)


def test_failed_write_can_be_repeated(spark, scratch):
    bad = spark.createDataFrame([("5",), ("no number",)], "s string").select(F.col("s").cast("int").alias("n"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        I.write_canonical(bad, f"{scratch}/t")
    assert not [n for n in os.listdir(scratch) if n.startswith("t")]
    I.write_canonical(bad.where("n > 0").limit(0), f"{scratch}/t")
    assert os.path.isdir(f"{scratch}/t")


def catalog(spark, scratch):
    cat = Catalog(spark, f"{scratch}/catalog")
    return cat, cat.ingest(put(scratch, "w.csv", WEATHER), "weather")


def test_apply_history_and_exports(spark, scratch):
    cat, v1 = catalog(spark, scratch)
    _, schema = cat.read(v1)
    col = lambda name: schema.resolve(name).column_id
    v2 = cat.apply(v1, P.FillNull(col("reading"), 0.0))
    assert cat.apply(v1, P.FillNull(col("reading"), 0.0)) == v2
    v3 = cat.apply(v2, P.Rename(col("station.id"), "station"))
    v4 = cat.apply(v3, P.Filter(col("reading"), "gte", 0.0))
    df, final = cat.read(v4)
    assert sorted(r.station for r in df.collect()) == [7, 8] and final.names[0] == "station"
    hist = cat.history(v4).collect()
    assert [(r.version_number, r.depth) for r in hist] == [(2, 2), (3, 1), (4, 0)]
    assert [r.parent_version_id for r in hist] == [v1, v2, v3] and all(r.created_at for r in hist)
    part = next(n for n in os.listdir(cat.data_path(v4)) if n.endswith(".parquet"))
    with open(f"{cat.data_path(v4)}/{part}", "rb") as f:
        assert f.read(4) == b"PAR1"


def test_retry_after_failures(spark, scratch, monkeypatch):
    cat, v1 = catalog(spark, scratch)
    _, schema = cat.read(v1)
    bad = P.Cast(schema.resolve("note, long").column_id, "integer")
    for _ in range(2):  # the same error again, not a leftover folder
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            cat.apply(v1, bad)
    good = P.Deduplicate()
    with monkeypatch.context() as m:  # the driver is lost between write and registration
        m.setattr(Catalog, "_register", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            cat.apply(v1, good)
    assert cat.versions().count() == 1
    v2 = cat.apply(v1, good)
    assert cat.read(v2)[0].count() == 3 and cat.versions().count() == 2
    # a second registration of the same version (another attempt) does not show
    row = cat.version(v2)
    cat._append_version((v2, *[row[c] for c in ("dataset_id", "dataset_name", "version_number", "parent_version_id")], "elsewhere",
                         *[row[c] for c in ("operation", "schema_json", "row_count", "byte_size")], row["created_at"].replace(year=2100)))
    assert cat.versions().count() == 2 and cat.data_path(v2) == row["data_path"]


def test_concurrent_writers_agree(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    cat, v1 = catalog(spark, scratch)
    _, schema = cat.read(v1)
    reading = schema.resolve("reading").column_id
    ops = [P.Deduplicate(), P.Deduplicate(), P.FillNull(reading, 0.0), P.FillNull(reading, 1.0)]
    payload = X.describe(cat.read(v1)[0], "reading", schema)
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda op: Catalog(spark, cat.root).apply(v1, op), ops))
        saves = list(pool.map(lambda _: Catalog(spark, cat.root).save_result(v1, "analysis", "t", {"a": 1}, payload), range(3)))
    assert ids[0] == ids[1] and len(set(ids)) == 3
    assert sorted(r.version_number for r in cat.versions().collect()) == [1, 2, 3, 4]
    assert len(set(saves)) == 1 and cat.list_results(v1).count() == 1
    assert cat.result_payload(saves[0]).collect() == payload.collect()


def test_claimed_version_is_completed(spark, scratch, monkeypatch):
    cat, v1 = catalog(spark, scratch)
    with monkeypatch.context() as m:  # lost after the claim: another version takes the next number meanwhile
        m.setattr(Catalog, "_append_version", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            cat.apply(v1, P.Deduplicate())
    _, schema = cat.read(v1)
    other = cat.apply(v1, P.FillNull(schema.resolve("reading").column_id, 0.0))
    late = cat.apply(v1, P.Deduplicate())
    assert cat.version(other)["version_number"] == 3 and cat.version(late)["version_number"] == 2
    assert len(os.listdir(f"{cat.root}/data")) == 3  # the claimed folder is used, not written again


def test_claims(spark, scratch):
    from tabspark.sources.claims import claim, read_claim

    folder = f"{scratch}/claims"
    assert read_claim(spark, folder, "a") is None
    assert claim(spark, folder, "a", "one\n") == "one\n" and claim(spark, folder, "a", "two") == "one\n"
    assert [n for n in os.listdir(folder) if not n.endswith(".crc")] == ["a"]


def test_long_lineage(spark, scratch):
    cat, v1 = catalog(spark, scratch)
    base = cat.version(v1)
    rows = [(f"v{i}", base["dataset_id"], "weather", i, v1 if i == 2 else f"v{i - 1}", "p", '{"type":"Filter"}', base["schema_json"], 1, 1, base["created_at"]) for i in range(2, 300)]
    from tabspark.sources.versions import VERSIONS_SCHEMA

    spark.createDataFrame(rows, VERSIONS_SCHEMA).write.mode("append").parquet(cat.versions_path)
    assert [r.version_number for r in cat.history("v299").collect()] == list(range(2, 300))
    with pytest.raises(VersionError):
        cat.version("nope")


def test_saved_results_of_any_size(spark, scratch):
    cat, v1 = catalog(spark, scratch)
    df, schema = cat.read(v1)
    payload = X.describe(df, "reading", schema)
    first = cat.save_result(v1, "analysis", "t", {"a": 1}, payload)
    assert cat.save_result(v1, "analysis", "t", {"a": 1}, payload) == first
    assert cat.list_results(v1).count() == 1
    assert cat.result_payload(first).collect() == payload.collect()
    large = cat.save_result(v1, "chart", "points", {}, spark.range(150_000).selectExpr("id", "id * 2 as `d.x`"))
    assert cat.result_payload(large).agg(F.count("*"), F.sum("`d.x`")).first()[:] == (150_000, 150_000 * 149_999)
    assert "position" in RESULT_ROWS_SCHEMA


def test_damaged_catalog_is_not_an_empty_one(spark, scratch):
    cat, _ = catalog(spark, scratch)
    assert Catalog(spark, f"{scratch}/new").versions().count() == 0
    put(f"{scratch}/catalog/versions", "part-x.parquet", "not parquet")
    with pytest.raises(Exception):
        cat.versions().collect()
