"""The build: profiles to a star schema of Parquet tables, views and governance files.

A warehouse is a folder of immutable snapshots and a folder of numbered manifests.  A build writes a
snapshot of its own, which nobody else touches, and then publishes it by one file: the manifest with
the next number, written only if there is none.  The newest whole manifest names the warehouse.  So
a reader sees one build or another, never parts of two; a build that dies leaves what was there; of
two builds at once both are published, one after the other.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import ref
from ..operators import gold
from ..operators.clean import null_counts
from ..operators.keys import with_row_number
from ..sources.files import Files, whole_path
from .clean import Lineage, clean, read_source
from .ddl import SHARED, full_view_sql, summary_sql, warehouse_ddl
from .diagram import markdown, mermaid
from .governance import audit_rows, column_records, dictionary_rows, lineage_rows
from .profile import DatasetProfile

VERSION = "1.0"
#: Files that each dataset's facts and patients are dealt to, and published snapshots that stay.
BUCKETS, KEEP = 8, 2
#: Datasets whose jobs run at once.
AT_ONCE = 4


@dataclass(frozen=True)
class Snapshot:
    """One published build; what it reads is of this build, whatever is published later."""

    spark: SparkSession
    folder: str
    buckets: int
    bucketed: tuple[str, ...]

    def path(self, name: str) -> str:
        """Where a governance file or table folder is."""
        return f"{self.folder}/{name}"

    def table(self, name: str) -> DataFrame:
        """A gold table; facts and patients know that they are bucketed by patient_record_id."""
        path = self.path(f"gold/{name}")
        if name not in self.bucketed:
            return self.spark.read.parquet(path)
        known = bucket_table(self.folder, name)
        if not self.spark.catalog.tableExists(known):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet CLUSTERED BY (patient_record_id) SORTED BY (patient_record_id) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(known)

    def register(self, profiles: list[DatasetProfile]) -> None:
        """Temporary views of all tables and of the queries over them."""
        for name in [*SHARED, *(p.fact_table for p in profiles)]:
            self.table(name).createOrReplaceTempView(name)
        for p in profiles:
            self.spark.sql(full_view_sql(p)).createOrReplaceTempView(f"vw_{p.name}_full")
        self.spark.sql(summary_sql(profiles)).createOrReplaceTempView("vw_disease_summary")

    def check(self, profiles: list[DatasetProfile]) -> dict[str, int]:
        """Violations of keys and references that Parquet does not enforce; all are 0 in a sound warehouse."""
        patients, found = self.table("dim_patient_record"), {}
        found["dim_patient_record keys"] = gold.repeated_keys(patients, "patient_record_id").count()
        for parent, key in (("dim_dataset", "dataset_id"), ("dim_gender", "gender_id"), ("dim_age_bracket", "age_bracket"), ("dim_etl_snapshot", "snapshot_id")):
            found[f"dim_patient_record.{key}"] = gold.orphans(patients, self.table(parent), key).count()
        for p in profiles:
            found[f"{p.fact_table}.patient_record_id"] = gold.orphans(self.table(p.fact_table), patients, "patient_record_id").count()
        return found


def bucket_table(folder: str, name: str) -> str:
    """The session's name of a bucketed table of a snapshot."""
    return f"{name}_{folder.rsplit('/', 1)[-1]}"


class Warehouse:
    """Builds into ``output``, a path or URI of a file system that driver and executors share, and reads what is published there."""

    def __init__(self, spark: SparkSession, root: str | Path, output: str | Path, version: str = VERSION, buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.root, self.output, self.version = spark, str(root), whole_path(str(output)), version
        self.buckets, self.keep, self.files = buckets, keep, Files(spark)

    def _manifests(self) -> list[tuple[int, dict]]:
        """(number, manifest) of the whole manifests whose snapshots are there, newest first; half-written ones do not count."""
        found = []
        for name in self.files.names(f"{self.output}/manifests"):
            if name.endswith(".json"):
                try:
                    told = json.loads(self.files.read(f"{self.output}/manifests/{name}"))
                except ValueError:
                    continue
                if self.files.exists(f"{self.output}/snapshots/{told['snapshot']}"):
                    found.append((int(name.removesuffix(".json")), told))
        return sorted(found, key=lambda m: -m[0])

    def _publish(self, manifest: dict) -> int:
        """Give the manifest the next number; who comes second takes the one after."""
        while True:
            taken = [int(n.removesuffix(".json")) for n in self.files.names(f"{self.output}/manifests") if n.endswith(".json")]
            number = max(taken, default=0) + 1
            if self.files.claim(f"{self.output}/manifests/{number:08}.json", json.dumps(manifest | {"number": number})):
                return number

    def _tidy(self) -> None:
        """Published snapshots beyond the last few go, manifest first; unpublished ones may be at work and stay."""
        for number, told in self._manifests()[self.keep :]:
            self.files.delete(f"{self.output}/manifests/{number:08}.json")
            self.files.delete(f"{self.output}/snapshots/{told['snapshot']}")

    def latest(self) -> Snapshot:
        """The newest published build."""
        for _, told in self._manifests():
            return Snapshot(self.spark, f"{self.output}/snapshots/{told['snapshot']}", told["buckets"], tuple(told["bucketed"]))
        raise FileNotFoundError(f"{self.output} has no published build")

    def path(self, name: str) -> str:
        return self.latest().path(name)

    def table(self, name: str) -> DataFrame:
        return self.latest().table(name)

    def register(self, profiles: list[DatasetProfile]) -> None:
        self.latest().register(profiles)

    def check(self, profiles: list[DatasetProfile]) -> dict[str, int]:
        return self.latest().check(profiles)

    def build(self, profiles: list[DatasetProfile]) -> dict:
        if not profiles:
            raise ValueError("no profiles to build")
        stamp, snapshot = datetime.now(UTC).replace(microsecond=0).isoformat(), 1
        bucketed = ("dim_patient_record", *(p.fact_table for p in profiles))
        made = Snapshot(self.spark, f"{self.output}/snapshots/{uuid.uuid4().hex}", self.buckets, bucketed)
        with ThreadPoolExecutor(AT_ONCE) as pool:  # jobs of several datasets fill the cluster together
            done = list(pool.map(lambda p: self._cleaned(p, made), profiles))
            logs: dict[str, Lineage] = {p.name: log for p, (_, log, _) in zip(profiles, done, strict=True)}
            records = [r for _, _, found in done for r in found]
            counts = {p.fact_table: logs[p.name].cleaned_rows for p in profiles}
            first = dict(zip(counts, accumulate(counts.values(), initial=1), strict=False))  # ids run on over datasets
            numbered = [(i, p, silver, first[p.fact_table]) for i, (p, (silver, _, _)) in enumerate(zip(profiles, done, strict=True), 1)]
            patients = reduce(DataFrame.unionAll, [gold.dim_patient_record(silver, p, i, at, snapshot) for i, p, silver, at in numbered])
            stored = pool.submit(self._store, made, "dim_patient_record", patients)
            fact_nulls = dict(pool.map(lambda x: self._facts(*x, snapshot, made), numbered))
            stored.result()
        shared = {
            "dim_etl_snapshot": [(snapshot, stamp, self.version, "full_refresh", "starloom", "profile-driven build")],
            "metadata_data_dictionary": dictionary_rows(records, snapshot),
            "metadata_lineage": lineage_rows(profiles, logs, counts, snapshot),
            "etl_audit_log": audit_rows(profiles, logs, fact_nulls, snapshot),
        }
        for name, rows in shared.items():
            self._write(self.spark.createDataFrame(rows, SHARED[name].replace(" NOT NULL", "")), made.path(f"gold/{name}"))
        for name, df in (("dim_dataset", gold.dim_dataset(self.spark, profiles, snapshot)), ("dim_age_bracket", gold.dim_age_bracket(self.spark)), ("dim_gender", gold.dim_gender(self.spark))):
            self._write(df, made.path(f"gold/{name}"))
        dictionary = [{"name": p.name, "display_name": p.display_name, "domain": p.domain, "description": p.description, "source_path": str(p.source_path), "fact_table": p.fact_table, "columns": [r for r in records if r["dataset"] == p.name]} for p in profiles]
        texts = {
            "schema.sql": warehouse_ddl(profiles),
            "data_dictionary.json": json.dumps({"datasets": dictionary}, indent=2, default=str),
            "lineage_report.json": json.dumps({n: vars(v) for n, v in logs.items()}, indent=2, default=str),
            "schema.mmd": mermaid(profiles),
            "schema.md": markdown(profiles, counts, stamp),
        }
        for name, text in texts.items():
            self.files.write(made.path(name), text)
        number = self._publish({"snapshot": made.folder.rsplit("/", 1)[-1], "stamp": stamp, "datasets": [p.name for p in profiles], "buckets": self.buckets, "bucketed": list(bucketed)})
        self._tidy()
        made.register(profiles)
        return {"snapshot_id": snapshot, "build": number, "folder": made.folder, "tables": counts, "lineage": logs}

    def _cleaned(self, p: DatasetProfile, made: Snapshot) -> tuple[DataFrame, Lineage, list[dict]]:
        """A dataset's stored clean rows, what was done to it, and its columns' records."""
        raw = read_source(self.spark, p, self.root)
        cleaned, log = clean(raw, p)
        records = column_records(raw, p)
        silver = self._write(with_row_number(cleaned, "source_record_num"), made.path(f"cleaned/{p.name}"))
        silver.drop("source_record_num").write.option("header", True).csv(made.path(f"cleaned_csv/{p.name}"))
        return silver, log, records

    def _facts(self, dataset_id: int, p: DatasetProfile, silver: DataFrame, first_id: int, snapshot: int, made: Snapshot) -> tuple[str, int]:
        """Store a dataset's facts; gives how many of their cells are null."""
        self._store(made, p.fact_table, gold.fact(silver, p, dataset_id, first_id, snapshot))
        there = [ref(c.fact_column) for c in p.fact_columns() if c.source in silver.columns]
        return p.name, sum(null_counts(made.table(p.fact_table).select(*there)).values()) if there else 0

    def _store(self, made: Snapshot, name: str, df: DataFrame) -> None:
        gold.stored_by_key(df, bucket_table(made.folder, name), made.path(f"gold/{name}"), "patient_record_id", self.buckets)

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def catalog(spark: SparkSession) -> DataFrame:
    """(name, type) of the session's tables and views, views first, then by name."""
    rows = sorted(((t.name, "table" if t.tableType not in ("TEMPORARY", "VIEW") else "view") for t in spark.catalog.listTables()), key=lambda r: (-ord(r[1][0]), r[0]))
    return spark.createDataFrame(rows, "name string, type string")
