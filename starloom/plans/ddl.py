"""Spark SQL DDL of the warehouse: Parquet tables and the views over them."""

from __future__ import annotations

from .profile import DatasetProfile

# The shared tables' columns, and column types by attribute type.
SHARED = {
    "dim_etl_snapshot": "snapshot_id INT NOT NULL, snapshot_timestamp STRING, pipeline_version STRING, load_type STRING, source_system STRING, notes STRING",
    "dim_dataset": "dataset_id INT NOT NULL, dataset_name STRING, display_name STRING, domain STRING, description STRING, profile_path STRING, source_path STRING, fact_table STRING, snapshot_id INT",
    "dim_age_bracket": "age_bracket STRING NOT NULL, sort_order INT, lower_age DOUBLE, upper_age DOUBLE",
    "dim_gender": "gender_id INT NOT NULL, gender_code STRING",
    "dim_patient_record": "patient_record_id BIGINT NOT NULL, snapshot_id INT, dataset_id INT, source_record_num BIGINT, age DOUBLE, gender_id INT, age_bracket STRING",
    "metadata_data_dictionary": "dictionary_id INT NOT NULL, snapshot_id INT, dataset_name STRING, table_name STRING, column_name STRING, source_column STRING, declared_type STRING, inferred_type STRING, attribute_type STRING, role STRING, description STRING, dtype STRING, null_count BIGINT, null_pct DOUBLE, distinct_count BIGINT, sample_values STRING, numeric_stats_json STRING, categorical_stats_json STRING",
    "metadata_lineage": "lineage_id INT NOT NULL, snapshot_id INT, dataset_name STRING, pipeline_stage STRING, source_object STRING, target_object STRING, row_count BIGINT, positive_count BIGINT, negative_count BIGINT, missing_cells BIGINT, duplicate_rows BIGINT, transformation_summary STRING",
    "etl_audit_log": "audit_id INT NOT NULL, snapshot_id INT, dataset_name STRING, audit_name STRING, metric_name STRING, metric_value DOUBLE, status STRING, details STRING",
}
SQL_TYPE = {"numeric": "DOUBLE", "binary": "INT", "nominal": "STRING", "ordinal": "STRING", "identifier": "BIGINT"}
FACT_KEYS = {"fact_id": "BIGINT NOT NULL", "patient_record_id": "BIGINT NOT NULL", "snapshot_id": "INT NOT NULL", "dataset_id": "INT NOT NULL"}


def fact_schema(profile: DatasetProfile) -> dict[str, str]:
    """Column names and types of a fact table, in order."""
    return FACT_KEYS | {c.fact_column: SQL_TYPE[c.type] for c in profile.fact_columns()} | {n: "STRING" for n in profile.fact_bands()} | {"label": "INT"}


def view_columns(profile: DatasetProfile) -> list[str]:
    keys = ["p.patient_record_id", "p.snapshot_id", "p.source_record_num", "p.age", "COALESCE(g.gender_code, 'Unknown') AS gender", "p.age_bracket"]
    return [*keys, *(f"f.`{n}`" for n in fact_schema(profile) if n not in FACT_KEYS and n != "label"), f"f.label AS `{profile.name}_label`"]


def full_view_sql(profile: DatasetProfile) -> str:
    return (
        "SELECT " + ", ".join(view_columns(profile)) + f"\nFROM {profile.fact_table} f\nJOIN dim_patient_record p ON p.patient_record_id = f.patient_record_id\n"
        f"LEFT JOIN dim_gender g ON g.gender_id = p.gender_id\nJOIN dim_dataset d ON d.dataset_id = p.dataset_id AND d.dataset_name = '{profile.name}'"
    )


def summary_sql(profiles: list[DatasetProfile]) -> str:
    one = "SELECT '{n}' AS dataset, COUNT(*) AS total_records, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS positive_cases, ROUND(100.0D * SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) / NULLIF(COUNT(*), 0), 2) AS positive_rate_pct FROM {t}"
    return "\nUNION ALL\n".join(one.format(n=p.name, t=p.fact_table) for p in profiles)


def warehouse_ddl(profiles: list[DatasetProfile]) -> str:
    tables = SHARED | {p.fact_table: ", ".join(f"`{n}` {t}" for n, t in fact_schema(p).items()) for p in profiles}
    views = {f"vw_{p.name}_full": full_view_sql(p) for p in profiles} | {"vw_disease_summary": summary_sql(profiles)}
    made = [f"CREATE OR REPLACE TABLE {n} ({c}) USING parquet;" for n, c in tables.items()]
    return "\n\n".join([*made, *(f"CREATE OR REPLACE VIEW {n} AS\n{s};" for n, s in views.items())]) + "\n"
