import pytest
from pyspark.sql import Row

from tabspark.operators import prepare as P
from tabspark.schema import DatasetColumn, DatasetSchema, attach


def _pipeline_frame(spark):
    df = spark.createDataFrame(
        [(18, "Pune", "x"), (25, None, "same"), (25, None, "same")], "age bigint, city string, secret string"
    )
    schema = DatasetSchema(
        (
            DatasetColumn("col_age", "age", "Age", "integer", "BIGINT"),
            DatasetColumn("col_city", "city", "city", "string", "STRING"),
            DatasetColumn("col_secret", "secret", "secret", "string", "STRING"),
        )
    )
    return attach(df, schema), schema


def test_filter_fill_drop_dedup(spark):
    df, schema = _pipeline_frame(spark)
    ops = [
        P.Filter("col_age", "gte", 20, operation_id="a"),
        P.FillNull("col_city", "Unknown", operation_id="b"),
        P.DropColumns(("col_secret",), operation_id="c"),
        P.Deduplicate(operation_id="d"),
    ]
    out = P.run(df, ops, schema)
    assert out.columns == ["age", "city"]
    assert [tuple(r) for r in out.collect()] == [(25, "Unknown")]
    assert P.validate(schema, ops) == ("col_age", "col_city")


def test_hostile_literal_is_a_value(spark):
    df, schema = _pipeline_frame(spark)
    out = P.run(df, [P.Filter("col_city", "eq", "x' OR TRUE --")], schema)
    assert out.count() == 0


def test_neq_drops_nulls(spark):
    df, schema = _pipeline_frame(spark)
    assert P.run(df, [P.Filter("col_city", "neq", "Pune")], schema).count() == 0
    assert P.run(df, [P.Filter("col_city", "is_null")], schema).count() == 2


def test_validation_errors(spark):
    _, schema = _pipeline_frame(spark)
    with pytest.raises(P.PipelineError, match="unknown column_id"):
        P.validate(schema, [P.DropColumns(("missing",))])
    with pytest.raises(P.PipelineError, match="cannot drop every column"):
        P.validate(schema, [P.DropColumns(("col_age", "col_city", "col_secret"))])
    with pytest.raises(P.PipelineError, match="requires a value"):
        P.Filter("col_age", "eq")
    with pytest.raises(P.PipelineError, match="does not take a value"):
        P.Filter("col_age", "is_null", 3)
    with pytest.raises(P.PipelineError, match="already exists"):
        P.validate(schema, [P.Rename("col_age", "city")])
    with pytest.raises(P.PipelineError, match="text column"):
        P.validate(schema, [P.FillNull("col_city", 3)])
    with pytest.raises(P.PipelineError, match="unique"):
        P.Pipeline((P.Deduplicate(), P.Deduplicate()))


def test_rename_keeps_id_and_later_ops_see_it(spark):
    df, schema = _pipeline_frame(spark)
    ops = [P.Rename("col_city", " town ", operation_id="r"), P.FillNull("col_city", "?", operation_id="f")]
    child = P.evolve(schema, ops)
    assert child.by_id("col_city").physical_name == "town"
    out = P.run(df, ops, schema)
    assert out.columns == ["age", "town", "secret"]
    assert sorted(r.town for r in out.collect()) == ["?", "?", "Pune"]


def test_cast_rounding_rules(spark):
    df = spark.createDataFrame([(2.5, "2.5"), (3.5, "3.5"), (-2.5, "-2.5")], "d double, s string")
    schema = DatasetSchema.of(df)
    out = P.run(df, [P.Cast("col_d", "integer"), P.Cast("col_s", "integer", operation_id="c2")], schema)
    rows = [tuple(r) for r in out.collect()]
    # binary double: half to even; decimal text: half away from zero
    assert rows == [(2, 3), (4, 4), (-2, -3)]
    assert P.evolve(schema, [P.Cast("col_d", "integer")]).by_id("col_d").data_type == "integer"


def test_strict_cast_fails_whole_op(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    with pytest.raises(Exception):
        P.run(df, [P.Cast("col_s", "integer")]).collect()


def test_fill_reports_true_type(spark):
    df = spark.createDataFrame([(1,), (None,)], "a bigint")
    schema = DatasetSchema.of(df)
    ops = [P.FillNull("col_a", 1.5)]
    assert P.evolve(schema, ops).by_id("col_a").data_type == "float"
    assert [r.a for r in P.run(df, ops, schema).collect()] == [1.0, 1.5]


def test_page_needs_order(spark):
    df, schema = _pipeline_frame(spark)
    with pytest.raises(P.PipelineError):
        P.run(df, [], schema, limit=1)
    page = P.run(df, [], schema, order_by=["col_age"], limit=1, offset=1)
    assert [r.age for r in page.collect()] == [25]


def test_dedup_after_drop_collapses_more(spark):
    df, schema = _pipeline_frame(spark)
    out = P.run(df, [P.DropColumns(("col_city", "col_secret")), P.Deduplicate(operation_id="d")], schema)
    assert sorted(r.age for r in out.collect()) == [18, 25]
    assert Row  # keep import used
