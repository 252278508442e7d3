"""The Prepare DSL: six typed operations folded over a DataFrame.

Each operation is a frozen dataclass that knows (a) how to check itself
against a ``DatasetSchema`` without touching data, (b) the schema it
produces, and (c) the DataFrame transformation.  A pipeline is an ordered
tuple of operations; ``run`` folds them over the input.  Nothing is
executed until an action: Catalyst collapses the projections, pushes the
filters into the Parquet scan and prunes the columns of the final select.

Literals always go through ``F.lit`` -- values are never spliced into SQL.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import row_order
from ..functions.casts import cast_to
from ..schema import CAST_TARGETS, DatasetColumn, DatasetSchema, SchemaError, col_of

Scalar = Union[bool, int, float, str]

# Filter operator names and the ones that take no value.
FILTER_OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "is_null", "not_null")
NULLARY_OPERATORS = frozenset({"is_null", "not_null"})
MAX_NAME_LENGTH = 255


class PipelineError(ValueError):
    """Raised when a pipeline does not fit the schema it is applied to."""


def _active(schema: DatasetSchema, column_id: str) -> DatasetColumn:
    try:
        return schema.by_id(column_id)
    except SchemaError:
        raise PipelineError(f"unknown column_id: {column_id}") from None


def _check_scalar(value: object) -> None:
    if not isinstance(value, (bool, int, float, str)):
        raise PipelineError("values must be a boolean, number or string")


def _literal_fits(column: DatasetColumn, value: Scalar) -> None:
    """Reject literal/column combinations that can only fail at run time."""
    kind = column.data_type
    if isinstance(value, bool):
        if kind in ("date", "datetime"):
            raise PipelineError(f"cannot compare {kind} column with a boolean")
        return
    if isinstance(value, (int, float)):
        if kind in ("string", "categorical", "date", "datetime"):
            raise PipelineError(f"cannot use a number with a {kind} column")
        return
    # strings: numeric and boolean columns take numeric/boolean text, temporal take ISO text
    return


@dataclass(frozen=True)
class Filter:
    column_id: str
    operator: str
    value: Scalar | None = None
    operation_id: str = "filter"

    def __post_init__(self) -> None:
        if self.operator not in FILTER_OPERATORS:
            raise PipelineError(f"unsupported filter operator: {self.operator}")
        if self.operator in NULLARY_OPERATORS:
            if self.value is not None:
                raise PipelineError(f"{self.operator} does not take a value")
        else:
            if self.value is None:
                raise PipelineError(f"{self.operator} requires a value")
            _check_scalar(self.value)

    def evolve(self, schema: DatasetSchema) -> DatasetSchema:
        column = _active(schema, self.column_id)
        if self.value is not None:
            _literal_fits(column, self.value)
        return schema

    def condition(self, schema: DatasetSchema) -> Column:
        c = col_of(_active(schema, self.column_id).physical_name)
        if self.operator == "is_null":
            return c.isNull()
        if self.operator == "not_null":
            return c.isNotNull()
        v = F.lit(self.value)
        return {
            "eq": c == v,
            "neq": c != v,
            "gt": c > v,
            "gte": c >= v,
            "lt": c < v,
            "lte": c <= v,
        }[self.operator]

    def apply(self, df: DataFrame, schema: DatasetSchema) -> DataFrame:
        return df.where(self.condition(schema))


@dataclass(frozen=True)
class DropColumns:
    column_ids: tuple[str, ...]
    operation_id: str = "drop_columns"

    def __post_init__(self) -> None:
        ids = tuple(self.column_ids)
        object.__setattr__(self, "column_ids", ids)
        if not ids:
            raise PipelineError("drop_columns needs at least one column")
        if len(set(ids)) != len(ids):
            raise PipelineError("drop_columns ids must be unique")

    def evolve(self, schema: DatasetSchema) -> DatasetSchema:
        for column_id in self.column_ids:
            _active(schema, column_id)
        kept = tuple(c for c in schema.columns if c.column_id not in self.column_ids)
        if not kept:
            raise PipelineError("cannot drop every column")
        return DatasetSchema(kept)

    def apply(self, df: DataFrame, schema: DatasetSchema) -> DataFrame:
        names = {_active(schema, i).physical_name for i in self.column_ids}
        return df.select(*[col_of(c) for c in df.columns if c not in names])


@dataclass(frozen=True)
class FillNull:
    column_id: str
    value: Scalar
    strategy: str = "constant"
    operation_id: str = "fill_null"

    def __post_init__(self) -> None:
        if self.strategy != "constant":
            raise PipelineError("fill_null supports only the constant strategy")
        if self.value is None:
            raise PipelineError("fill_null requires a value")
        _check_scalar(self.value)

    def _check(self, column: DatasetColumn) -> None:
        v = self.value
        kind = column.data_type
        numeric_value = isinstance(v, (int, float)) and not isinstance(v, bool)
        if kind in ("string", "categorical") and not isinstance(v, str):
            raise PipelineError("a text column can only be filled with text")
        if kind in ("integer", "float") and not (numeric_value or isinstance(v, str)):
            raise PipelineError("a numeric column can only be filled with a number")
        if kind == "boolean" and numeric_value:
            raise PipelineError("a boolean column can only be filled with a boolean")
        if kind in ("date", "datetime") and not isinstance(v, str):
            raise PipelineError(f"a {kind} column is filled with ISO text")

    def evolve(self, schema: DatasetSchema) -> DatasetSchema:
        column = _active(schema, self.column_id)
        self._check(column)
        # COALESCE(bigint, 1.5) widens to double: report the true type.
        if column.data_type == "integer" and isinstance(self.value, float):
            from dataclasses import replace

            return schema.replace_column(replace(column, data_type="float", storage_type="DOUBLE"))
        return schema

    def apply(self, df: DataFrame, schema: DatasetSchema) -> DataFrame:
        column = _active(schema, self.column_id)
        name = column.physical_name
        value = F.lit(self.value)
        if column.data_type == "date":
            value = value.cast("date")
        elif column.data_type == "datetime":
            value = value.cast("timestamp_ntz")
        filled = F.coalesce(col_of(name), value).alias(name)
        return df.select(*[filled if c == name else col_of(c) for c in df.columns])


@dataclass(frozen=True)
class Deduplicate:
    operation_id: str = "deduplicate"

    def evolve(self, schema: DatasetSchema) -> DatasetSchema:
        return schema

    def apply(self, df: DataFrame, schema: DatasetSchema) -> DataFrame:
        # DISTINCT over the *current* columns; Spark hashes on all of them and
        # combines map-side, so a hot duplicate group is reduced before the shuffle.
        return df.dropDuplicates()


@dataclass(frozen=True)
class Rename:
    column_id: str
    new_name: str
    operation_id: str = "rename_column"

    def __post_init__(self) -> None:
        name = (self.new_name or "").strip()
        if not name:
            raise PipelineError("new_name must not be blank")
        if len(name) > MAX_NAME_LENGTH:
            raise PipelineError("new_name must be at most 255 characters")
        object.__setattr__(self, "new_name", name)

    def evolve(self, schema: DatasetSchema) -> DatasetSchema:
        from dataclasses import replace

        column = _active(schema, self.column_id)
        for other in schema.columns:
            if other.column_id != column.column_id and other.physical_name.lower() == self.new_name.lower():
                raise PipelineError(f"column name already exists: {self.new_name}")
        return schema.replace_column(
            replace(column, physical_name=self.new_name, display_name=self.new_name)
        )

    def apply(self, df: DataFrame, schema: DatasetSchema) -> DataFrame:
        old = _active(schema, self.column_id).physical_name
        return df.select(*[col_of(c).alias(self.new_name) if c == old else col_of(c) for c in df.columns])


# Storage type names reported after a cast.
_CAST_STORAGE = {
    "boolean": "BOOLEAN",
    "integer": "BIGINT",
    "float": "DOUBLE",
    "string": "STRING",
    "date": "DATE",
    "datetime": "TIMESTAMP_NTZ",
}


@dataclass(frozen=True)
class Cast:
    column_id: str
    target_type: str
    operation_id: str = "cast_column"

    def __post_init__(self) -> None:
        if self.target_type not in CAST_TARGETS:
            raise PipelineError(f"unsupported cast target: {self.target_type}")

    def evolve(self, schema: DatasetSchema) -> DatasetSchema:
        from dataclasses import replace

        column = _active(schema, self.column_id)
        return schema.replace_column(
            replace(column, data_type=self.target_type, storage_type=_CAST_STORAGE[self.target_type])
        )

    def apply(self, df: DataFrame, schema: DatasetSchema) -> DataFrame:
        column = _active(schema, self.column_id)
        name = column.physical_name
        source = df.schema[name].dataType
        converted = cast_to(col_of(name), source, self.target_type).alias(name)
        return df.select(*[converted if c == name else col_of(c) for c in df.columns])


Operation = Union[Filter, DropColumns, FillNull, Deduplicate, Rename, Cast]


@dataclass(frozen=True)
class Pipeline:
    operations: tuple = field(default_factory=tuple)
    schema_version: int = 1

    def __post_init__(self) -> None:
        ops = tuple(self.operations)
        object.__setattr__(self, "operations", ops)
        op_ids = [op.operation_id for op in ops]
        if len(set(op_ids)) != len(op_ids):
            raise PipelineError("operation ids must be unique")


def _as_pipeline(ops) -> Pipeline:
    if isinstance(ops, Pipeline):
        return ops
    ops = tuple(ops)
    # Give unnamed operations unique ids so a list of ops is always a valid pipeline.
    renamed = []
    seen: set[str] = set()
    for i, op in enumerate(ops):
        if op.operation_id in seen:
            from dataclasses import replace

            op = replace(op, operation_id=f"{op.operation_id}_{i}")
        seen.add(op.operation_id)
        renamed.append(op)
    return Pipeline(tuple(renamed))


def evolve(schema: DatasetSchema, ops) -> DatasetSchema:
    """Schema after the pipeline, predicted without data (errors raised here)."""
    pipeline = _as_pipeline(ops)
    return functools.reduce(lambda s, op: op.evolve(s), pipeline.operations, schema)


def validate(schema: DatasetSchema, ops) -> tuple[str, ...]:
    """Check a pipeline against a schema; return the ids still active after it."""
    return evolve(schema, ops).ids


def run(
    df: DataFrame,
    ops,
    schema: DatasetSchema | None = None,
    select: list[str] | None = None,
    order_by: list[str] | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Fold the pipeline over ``df``; optional selection (by id) and a page.

    A page without ``order_by`` (ids) follows the files of a Parquet scan; where the pipeline loses
    the rows' addresses (duplicates removed), it needs an order.
    """
    schema = schema or DatasetSchema.of(df)
    pipeline = _as_pipeline(ops)
    current_schema = schema
    for op in pipeline.operations:
        next_schema = op.evolve(current_schema)
        df = op.apply(df, current_schema)
        current_schema = next_schema
    if select is not None:
        if not select:
            raise PipelineError("selected_column_ids must not be empty")
        df = df.select(*[col_of(_active(current_schema, i).physical_name) for i in select])
    if limit is not None or offset:
        if offset < 0:
            raise PipelineError(f"a page cannot start at row {offset}")
        if not order_by and limit is not None and row_order.has_address(df):
            return row_order.page(df, offset, limit)
        if not order_by:
            raise PipelineError("these rows have no file order: name the order of the page")
        keys = [col_of(_active(current_schema, i).physical_name).asc_nulls_last() for i in order_by]
        df = df.orderBy(*keys)
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
    return df


__all__ = [
    "Filter",
    "DropColumns",
    "FillNull",
    "Deduplicate",
    "Rename",
    "Cast",
    "Pipeline",
    "PipelineError",
    "evolve",
    "validate",
    "run",
]
