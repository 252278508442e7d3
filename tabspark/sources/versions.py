"""Immutable versions, lineage and saved results as append-only Parquet tables.

A *catalog root* is a folder on shared storage holding

* ``versions/``  -- one row per dataset version (id, dataset, number, parent,
                    data path, the operation that produced it, schema JSON);
* ``data/<id>-<attempt>/`` -- the canonical Parquet of each version;
* ``results/``, ``result_rows/`` -- saved analysis/chart/model results keyed by fingerprint, and
                    their payloads as one JSON row per payload row.

* ``claims/``  -- one small file per derived version, version number and saved result (``claims.py``).

A version exists once its row is registered; the row names the folder that holds its data.  Every
attempt writes a folder of its own, then claims the version with that folder, then its number, and
registers last.  Only one attempt can make a claim, so concurrent applies or saves give one version,
one number and one result; an attempt that fails leaves an unregistered folder, and one whose driver
is lost after the claim is completed by the next from what the claim says.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prepare as P
from ..schema import DatasetColumn, DatasetSchema, attach, col_of
from ..session import written
from .claims import append_rows, claim, read_claim
from .ingest import Manifest, byte_size, ingest, write_canonical

VERSIONS_SCHEMA = (
    "version_id string, dataset_id string, dataset_name string, version_number int, parent_version_id string, "
    "data_path string, operation string, schema_json string, row_count bigint, byte_size bigint, created_at timestamp_ntz"
)
RESULTS_SCHEMA = (
    "result_id string, version_id string, kind string, title string, fingerprint string, "
    "configuration string, columns string, created_at timestamp_ntz"
)
RESULT_KINDS = ("analysis", "chart", "model")
RESULT_ROWS_SCHEMA = "result_id string, position long, row string"


class VersionError(ValueError):
    pass


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def schema_to_json(schema: DatasetSchema) -> str:
    return json.dumps([dataclasses.asdict(c) for c in schema.columns], sort_keys=True)


def schema_from_json(text: str) -> DatasetSchema:
    return DatasetSchema(tuple(DatasetColumn(**c) for c in json.loads(text)))


def operation_to_json(op) -> str:
    body = dataclasses.asdict(op)
    body["type"] = type(op).__name__
    return json.dumps(body, sort_keys=True, separators=(",", ":"))


_OPS = {cls.__name__: cls for cls in (P.Filter, P.DropColumns, P.FillNull, P.Deduplicate, P.Rename, P.Cast)}


def operation_from_json(text: str):
    body = json.loads(text)
    cls = _OPS[body.pop("type")]
    if "column_ids" in body:
        body["column_ids"] = tuple(body["column_ids"])
    return cls(**body)


class Catalog:
    """Versions and saved results under one shared root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths ---------------------------------------------------------------
    @property
    def versions_path(self) -> str:
        return f"{self.root}/versions"

    @property
    def results_path(self) -> str:
        return f"{self.root}/results"

    def data_path(self, version_id: str) -> str:
        return self.version(version_id)["data_path"]

    def _attempt_path(self, version_id: str) -> str:
        return f"{self.root}/data/{version_id}-{uuid.uuid4().hex[:12]}"

    def _table(self, path: str, schema: str) -> DataFrame:
        """A table of the catalog; empty only if nothing was ever written to it."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # -- versions ------------------------------------------------------------
    def versions(self) -> DataFrame:
        rows = self._table(self.versions_path, VERSIONS_SCHEMA)
        first = F.min_by(F.struct(*rows.columns), F.struct("created_at", "data_path")).alias("_row")
        return rows.groupBy("version_id").agg(first).select("_row.*")

    def _append_version(self, row: tuple) -> None:
        append_rows(self.spark.createDataFrame([row], VERSIONS_SCHEMA), self.versions_path)

    def version(self, version_id: str) -> dict:
        rows = self.versions().where(F.col("version_id") == version_id).limit(1).collect()
        if not rows:
            raise VersionError(f"unknown version: {version_id}")
        return rows[0].asDict()

    def read(self, version_id: str) -> tuple[DataFrame, DatasetSchema]:
        v = self.version(version_id)
        return self.spark.read.parquet(v["data_path"]), schema_from_json(v["schema_json"])

    def ingest(self, source: str, dataset_name: str, fmt: str | None = None, **kw) -> str:
        """Ingest a file as version 1 of a new dataset; returns the version id."""
        version_id = uuid.uuid4().hex
        path = self._attempt_path(version_id)
        df, manifest = ingest(self.spark, source, path, fmt, **kw)
        # The ingest itself is the operation of version 1: it keeps the source's format.
        op_json = json.dumps({"type": "Ingest", "source_format": manifest.source_format, "canonical_format": manifest.canonical_format})
        self._register(self._row(version_id, uuid.uuid4().hex, dataset_name, None, path, manifest, op_json), 1)
        return version_id

    @staticmethod
    def _row(version_id, dataset_id, name, parent, path, manifest: Manifest, op_json) -> dict:
        """The row of a version but for its number, as JSON can hold it."""
        return {
            "version_id": version_id, "dataset_id": dataset_id, "dataset_name": name, "parent_version_id": parent, "data_path": path,
            "operation": op_json, "schema_json": schema_to_json(manifest.schema), "row_count": manifest.row_count,
            "byte_size": manifest.byte_size, "created_at": _now().isoformat(),
        }

    def _register(self, row: dict, number: int) -> None:
        row = {**row, "version_number": number, "created_at": datetime.fromisoformat(row["created_at"])}
        self._append_version(tuple(row[c.split(" ")[0]] for c in VERSIONS_SCHEMA.split(", ")))

    def _complete(self, row: dict) -> None:
        """Number and register a claimed version; repeating it changes nothing.

        Every attempt looks for the number from the parent's on and stops at the first that is free or
        already this version's, so all find the same one.
        """
        taken = self.versions().where((F.col("dataset_id") == row["dataset_id"]) & (F.col("version_id") != row["version_id"]))
        parent = taken.where(F.col("version_id") == row["parent_version_id"]).select("version_number").first()
        later = taken.where(F.col("version_number") > parent[0]).agg(F.max("version_number"), F.count_distinct("version_number")).first()
        # Where others hold all numbers up to the last one, the search starts behind it.
        full = later[1] > 0 and later[1] == later[0] - parent[0]
        number = later[0] + 1 if full else parent[0] + 1
        while claim(self.spark, f"{self.root}/claims/{row['dataset_id']}", f"{number:09d}", row["version_id"]) != row["version_id"]:
            number += 1
        self._register(row, number)

    @staticmethod
    def idempotency_key(version_id: str, op) -> str:
        """sha256 of the parent id and the operation JSON (sorted keys)."""
        return hashlib.sha256(f"{version_id}:{operation_to_json(op)}".encode()).hexdigest()

    def apply(self, parent_id: str, op) -> str:
        """Derive a child version from ONE operation; repeats return the same id."""
        child_id = self.idempotency_key(parent_id, op)[:32]
        if not self.versions().where(F.col("version_id") == child_id).isEmpty():
            return child_id
        folder = f"{self.root}/claims/versions"
        held = read_claim(self.spark, folder, child_id)
        if held is None:
            parent = self.version(parent_id)
            df, schema = self.read(parent_id)
            child_schema = P.evolve(schema, [op])
            out = P.run(df, [op], schema)
            path = self._attempt_path(child_id)
            write_canonical(attach(out, child_schema), path)
            count = self.spark.read.parquet(path).count()
            manifest = Manifest("parquet", "parquet", count, byte_size(self.spark, path), child_schema)
            row = self._row(child_id, parent["dataset_id"], parent["dataset_name"], parent_id, path, manifest, operation_to_json(op))
            held = claim(self.spark, folder, child_id, json.dumps(row))
        self._complete(json.loads(held))
        return child_id

    def _ancestors(self, pairs: DataFrame, version_id: str) -> DataFrame:
        """(version_id, depth) of a version and its ancestors by pointer doubling.

        Round k joins the 2^k nearest with jumps of 2^k, so a chain of n versions takes log2(n) rounds
        and no pair reaches the driver.  A damaged (cyclic) chain ends with the number of versions.
        """
        pairs = written(pairs, "lineage-pairs")
        known = self.spark.createDataFrame([(version_id, 0)], "version_id string, depth int")
        jumps = pairs.select(F.col("version_id").alias("at"), F.col("parent_version_id").alias("to")).where("to is not null")
        step, most = 1, pairs.count()
        while step <= most:
            further = known.join(jumps, F.col("version_id") == F.col("at")).select(F.col("to").alias("version_id"), (F.col("depth") + step).alias("depth"))
            further = written(further, "lineage-further")
            if further.isEmpty():
                break
            known = written(known.union(further), "lineage-known")
            again = jumps.select(F.col("at").alias("mid"), F.col("to").alias("end"))
            jumps = written(jumps.join(again, F.col("to") == F.col("mid")).select("at", F.col("end").alias("to")), "lineage-jumps")
            step *= 2
        return known.groupBy("version_id").agg(F.min("depth").alias("depth"))

    def history(self, version_id: str) -> DataFrame:
        """The operations from the root to ``version_id``, oldest first, of any depth."""
        own = self.version(version_id)
        all_rows = self.versions().where(F.col("dataset_id") == own["dataset_id"])
        depths = self._ancestors(all_rows.select("version_id", "parent_version_id"), version_id)
        rows = all_rows.join(depths, "version_id").where(F.col("parent_version_id").isNotNull())
        return rows.select(
            "version_id", "parent_version_id", "version_number", "operation", "row_count", "created_at", "depth"
        ).orderBy("version_number")

    # -- saved results ---------------------------------------------------------
    def results(self) -> DataFrame:
        # A result completed twice has two equal rows.
        return self._table(self.results_path, RESULTS_SCHEMA).dropDuplicates(["result_id"])

    @staticmethod
    def fingerprint(kind: str, version_id: str, configuration: dict) -> str:
        return hashlib.sha256(
            json.dumps([kind, version_id, configuration], sort_keys=True, separators=(",", ":")).encode()
        ).hexdigest()

    def save_result(self, version_id: str, kind: str, title: str, configuration: dict, payload: DataFrame) -> str:
        """Save once per (version, fingerprint); the payload is stored as JSON rows of any number."""
        if kind not in RESULT_KINDS:
            raise VersionError(f"unsupported result kind: {kind}")
        self.version(version_id)
        fp = self.fingerprint(kind, version_id, configuration)
        found = self.results().where((F.col("version_id") == version_id) & (F.col("fingerprint") == fp)).select(
            "result_id"
        ).limit(1).collect()
        if found:
            return found[0]["result_id"]
        folder, name = f"{self.root}/claims/results", hashlib.sha256(f"{version_id}:{fp}".encode()).hexdigest()
        held = read_claim(self.spark, folder, name)
        if held is None:
            result_id = uuid.uuid4().hex
            # Payload rows first, one JSON text each; they count once the result itself is claimed.
            rows = payload.select(
                F.monotonically_increasing_id().alias("position"),
                F.to_json(F.struct(*[col_of(c) for c in payload.columns]), {"ignoreNullFields": "false"}).alias("row"),
            )
            rows.write.parquet(f"{self.root}/result_rows/result_id={result_id}")
            row = [result_id, version_id, kind, title, fp, json.dumps(configuration, sort_keys=True), payload.schema.json(), _now().isoformat()]
            held = claim(self.spark, folder, name, json.dumps(row))
        *row, created = json.loads(held)
        append_rows(self.spark.createDataFrame([(*row, datetime.fromisoformat(created))], RESULTS_SCHEMA), self.results_path)
        return row[0]

    def result_payload(self, result_id: str) -> DataFrame:
        """The payload of a saved result with its own columns and types, in its saved order."""
        found = self.results().where(F.col("result_id") == result_id).limit(1).collect()
        if not found:
            raise VersionError(f"unknown result: {result_id}")
        schema = T.StructType.fromJson(json.loads(found[0]["columns"]))
        rows = self._table(f"{self.root}/result_rows", RESULT_ROWS_SCHEMA).where(F.col("result_id") == result_id)
        return rows.select("position", F.from_json("row", schema).alias("r")).orderBy("position").select("r.*")

    def list_results(self, version_id: str) -> DataFrame:
        return self.results().where(F.col("version_id") == version_id).orderBy(
            F.col("created_at").desc(), F.col("result_id").desc()
        )
