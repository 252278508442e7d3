from tabspark.operators import profile as PR


def _customers(spark):
    return spark.createDataFrame(
        [("Ada", 36, "A"), ("Grace", None, "A"), ("Ada", 36, "A")], "name string, age bigint, segment string"
    )


def test_profile_customers(spark):
    df = _customers(spark)
    ds, cols, warns = PR.profile(df, exact_distinct=True)
    d = ds.first()
    assert (d.row_count, d.column_count, d.missing_cells) == (3, 3, 1)
    assert d.missing_percentage == 11.11
    assert (d.duplicate_rows, d.duplicate_percentage) == (1, 33.33)
    by = {r.name: r for r in cols.collect()}
    assert by["age"].null_count == 1 and by["age"].null_percentage == 33.33
    assert by["segment"].distinct_count == 1
    assert {r.code for r in warns.collect()} == {"missing_values", "duplicate_rows", "constant_columns"}


def test_column_profiles_single_scan_matches(spark):
    df = _customers(spark)
    fast = {r.name: (r.null_count, r.distinct_count) for r in PR.column_profiles(df, exact_distinct=True).collect()}
    assert fast == {"name": (0, 2), "age": (1, 1), "segment": (0, 1)}


def test_empty_frame_percentages(spark):
    df = spark.createDataFrame([], "a bigint")
    d = PR.dataset_profile(df).first()
    assert (d.row_count, d.missing_percentage, d.duplicate_rows) == (0, 0.0, 0)
    assert PR.profile_warnings(df).count() == 0
