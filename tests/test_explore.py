import pytest

from tabspark.operators import explore as X


def _explore(spark):
    return spark.createDataFrame(
        [("A", "North", 20, 100), ("A", "South", 30, 200), ("B", "North", 40, 300), ("B", "South", 50, 400),
         ("B", "South", 60, 500)],
        "segment string, region string, age bigint, income bigint",
    )


def test_describe(spark):
    r = X.describe(_explore(spark), "age").first()
    assert (r.valid_count, r.mean, r.median, r.minimum, r.maximum) == (5, 40.0, 40.0, 20, 60)
    assert (r.q1, r.q3) == (30.0, 50.0)


def test_frequencies_and_bar(spark):
    rows = X.frequencies(_explore(spark), "segment").collect()
    top = min(rows, key=lambda r: r.rank)
    assert (top.value, top["count"], top.total_rows, top.truncated) == ("B", 3, 5, False)
    assert X.frequencies(_explore(spark), "segment", limit=1).first().truncated is True


def test_correlation_and_heatmap(spark):
    df = _explore(spark)
    cells = {(r.row_column, r.column_column): r.r for r in X.correlation(df).collect()}
    assert cells[("age", "income")] == pytest.approx(1.0)
    assert X.heatmap(df).count() == 4


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    cells = {(r.row_column, r.column_column): r.r for r in X.correlation(df).collect()}
    assert cells[("a", "b")] is None and cells[("a", "a")] is None


def test_crosstab(spark):
    rows = X.crosstab(_explore(spark), "segment", "region").collect()
    assert rows[0].total == 5 and not rows[0].row_truncated and not rows[0].column_truncated
    with pytest.raises(X.ExploreError):
        X.crosstab(_explore(spark), "age", "region")


def test_truncated_crosstab(spark):
    df = spark.createDataFrame(
        [("A", "North"), ("A", "South"), ("B", "East"), ("B", "North"), ("C", "West")], "group string, region string"
    )
    rows = X.crosstab(df, "group", "region", limit=2).collect()
    assert rows[0].row_truncated and rows[0].column_truncated
    assert rows[0].total < 5
    assert len(rows) == 4  # dense 2 x 2 grid, zero-filled


def test_charts(spark):
    df = _explore(spark)
    assert sum(r["count"] for r in X.histogram(df, "age", bins=5).collect()) == 5
    assert X.scatter(df, "age", "income").count() == 5
    b = X.box(df, "income").first()
    assert [b.minimum, b.q1, b.median, b.q3, b.maximum] == [100, 200, 300, 400, 500]
    pts, fit = X.qq(df, "age")
    assert pts.count() == 5 and fit.first().sample_size == 5
    with pytest.raises(X.ExploreError):
        X.histogram(df, "age", bins=4)


def test_box_by_group_missing_label(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    labels = {r.category for r in X.box(df, "x", group="g").collect()}
    assert labels == {"(missing)", "a"}


def test_describe_approx_quantiles(spark):
    r = X.describe(_explore(spark), "age", quantiles="approx").first()
    assert r.median == 40.0 and r.q1 in (30.0, 20.0) and r.mean == 40.0
