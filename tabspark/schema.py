"""Logical column types, column roles and the dataset schema.

A dataset version is a Parquet directory plus a ``DatasetSchema``.  Every
column has a stable ``column_id`` (kept in ``StructField.metadata`` so it
survives renames and round trips through Parquet), a physical name, a
display name and a logical type derived from the Spark ``DataType`` class.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The logical type names of the data model.
LOGICAL_TYPES = (
    "boolean",
    "integer",
    "float",
    "string",
    "date",
    "datetime",
    "categorical",
    "unknown",
)
NUMERIC = frozenset({"integer", "float"})
TEMPORAL = frozenset({"date", "datetime"})
CATEGORICAL_ROLE = frozenset({"boolean", "string", "categorical"})
CAST_TARGETS = ("boolean", "integer", "float", "string", "date", "datetime")

META_ID = "column_id"
META_DISPLAY = "display_name"
META_LOGICAL = "logical_type"


def col_of(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


class SchemaError(ValueError):
    """Raised for invalid schemas, unknown columns and role mismatches."""


def logical_type(dtype: T.DataType, metadata: dict | None = None) -> str:
    """Map a Spark type to a logical type by class (nested and interval -> unknown)."""
    if metadata and metadata.get(META_LOGICAL) == "categorical":
        return "categorical"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "unknown"


def new_column_id() -> str:
    return f"col_{uuid.uuid4().hex}"


@dataclass(frozen=True)
class DatasetColumn:
    column_id: str
    physical_name: str
    display_name: str
    data_type: str
    storage_type: str
    nullable: bool = True

    @property
    def is_numeric(self) -> bool:
        return self.data_type in NUMERIC

    @property
    def is_temporal(self) -> bool:
        return self.data_type in TEMPORAL

    @property
    def is_categorical(self) -> bool:
        return self.data_type in CATEGORICAL_ROLE


@dataclass(frozen=True)
class DatasetSchema:
    columns: tuple[DatasetColumn, ...]
    schema_version: int = field(default=1)

    def __post_init__(self) -> None:
        if not self.columns:
            raise SchemaError("a schema needs at least one column")
        ids = [c.column_id for c in self.columns]
        names = [c.physical_name for c in self.columns]
        if len(set(ids)) != len(ids):
            raise SchemaError("column ids must be unique")
        if len(set(names)) != len(names):
            raise SchemaError("physical names must be unique")
        if self.schema_version != 1:
            raise SchemaError("unsupported schema_version")

    # -- lookups ---------------------------------------------------------
    def by_id(self, column_id: str) -> DatasetColumn:
        for column in self.columns:
            if column.column_id == column_id:
                return column
        raise SchemaError(f"unknown column_id: {column_id}")

    def resolve(self, ref: str) -> DatasetColumn:
        """Resolve a column id, or failing that a current physical name."""
        for column in self.columns:
            if column.column_id == ref:
                return column
        for column in self.columns:
            if column.physical_name == ref:
                return column
        raise SchemaError(f"unknown column_id: {ref}")

    @property
    def ids(self) -> tuple[str, ...]:
        return tuple(c.column_id for c in self.columns)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c.physical_name for c in self.columns)

    def replace_column(self, column: DatasetColumn) -> "DatasetSchema":
        return DatasetSchema(
            tuple(column if c.column_id == column.column_id else c for c in self.columns)
        )

    # -- conversions -----------------------------------------------------
    @classmethod
    def from_struct(cls, struct: T.StructType, mint_ids: bool = False) -> "DatasetSchema":
        """Build a schema from a Spark struct.

        Ids come from field metadata when present.  Otherwise they are minted:
        random (``mint_ids=True``, as at ingest) or ``col_<name>`` so that
        frames read straight from Parquet get stable, readable ids.
        """
        columns = []
        for f in struct.fields:
            meta = dict(f.metadata or {})
            column_id = meta.get(META_ID) or (new_column_id() if mint_ids else f"col_{f.name}")
            columns.append(
                DatasetColumn(
                    column_id=column_id,
                    physical_name=f.name,
                    display_name=meta.get(META_DISPLAY) or f.name,
                    data_type=logical_type(f.dataType, meta),
                    storage_type=f.dataType.simpleString().upper(),
                    nullable=bool(f.nullable),
                )
            )
        return cls(tuple(columns))

    @classmethod
    def of(cls, df: DataFrame, mint_ids: bool = False) -> "DatasetSchema":
        return cls.from_struct(df.schema, mint_ids=mint_ids)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The schema as a DataFrame (one row per column, in order)."""
        rows = [
            (i, c.column_id, c.physical_name, c.display_name, c.data_type, c.storage_type, c.nullable)
            for i, c in enumerate(self.columns)
        ]
        return spark.createDataFrame(
            rows,
            "position int, column_id string, physical_name string, display_name string, "
            "data_type string, storage_type string, nullable boolean",
        )


def attach(df: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Write ids and display names into the field metadata of ``df``."""
    cols = []
    for column in schema.columns:
        meta = {META_ID: column.column_id, META_DISPLAY: column.display_name}
        if column.data_type == "categorical":
            meta[META_LOGICAL] = "categorical"
        cols.append(col_of(column.physical_name).alias(column.physical_name, metadata=meta))
    return df.select(*cols)

