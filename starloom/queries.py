"""The catalogue: one query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.values import strip
from .inference import engine, providers
from .inference.tables import RANGES
from .operators import clean as ops
from .operators import gold, keys, stats
from .plans.governance import audit_rows, column_records, lineage_counts
from .plans.clean import clean, labelled, row_level
from .plans.warehouse import BUCKETS
from .plans.profile import Band, ColumnSpec, DatasetProfile, DropRule, TargetSpec, parse_profile
from .sources.delimited import na_to_null, read_delimited, replace_tokens, type_counts

cloudpickle.register_pickle_by_value(providers)  # workers need no copy of the package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STRING, DOUBLE, LONG, INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which all machines share."""
    return f"{keys.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of a table reader and the session under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Profiles over the driver's tables, which have no nulls of their own.
def _bands(*pairs) -> list[dict]:
    return [{"label": a, "upper_exclusive": b} for a, b in pairs]


_AGE_YAML = _bands(("0-17", 18), ("18-39", 40), ("40-59", 60), ("60-79", 80), ("80+", ".inf"))
ORDERS = parse_profile(
    {
        "name": "orders",
        "source": {"path": "orders.parquet", "format": "parquet"},
        "target": {"column": "o_orderpriority"},
        "columns": [
            {"source": "o_orderkey", "type": "identifier"},
            {"source": "o_custkey", "type": "numeric", "role": "descriptor"},
            {"source": "o_orderstatus", "type": "binary", "role": "gender", "mapping": {"F": 0, "O": 1}},
            {"source": "o_totalprice", "type": "numeric", "role": "age", "scale_factor": 0.0002},
            {"source": "o_orderdate", "type": "nominal", "drop": True},
            {"source": "o_orderpriority", "type": "binary", "mapping": {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 0, "4-NOT SPECIFIED": 0, "5-LOW": 0}},
        ],
        "hierarchies": [{"source_column": "o_totalprice", "new_column": "age_bracket", "bands": _AGE_YAML}, {"source_column": "o_custkey", "new_column": "customer_band", "bands": _bands(("low", 500), ("high", ".inf"))}],
    }
)
EVENTS = parse_profile(
    {
        "name": "events",
        "source": {"path": "events.parquet", "format": "parquet"},
        "target": {"column": "event_type"},
        "columns": [
            {"source": "event_id", "type": "identifier"},
            {"source": "ts", "type": "nominal", "drop": True},
            {"source": "user_id", "type": "numeric", "role": "age"},
            {"source": "value", "type": "numeric", "role": "lab"},
            {"source": "props", "type": "nominal", "drop": True},
            {"source": "event_type", "type": "binary", "mapping": {"purchase": 1, "view": 0, "click": 0, "signup": 0, "error": 0}},
        ],
        "cleaning": {"drop_rows_where": [{"column": "event_type", "value": "ERROR", "ci": True}]},
    }
)
CUSTOMER = parse_profile(
    {
        "name": "customer",
        "source": {"path": "customer.parquet", "format": "parquet"},
        "target": {"column": "c_nationkey"},
        "columns": [
            {"source": "c_custkey", "type": "identifier"},
            {"source": "c_name", "type": "nominal", "drop": True},
            {"source": "c_acctbal", "type": "numeric", "role": "age", "scale_factor": 0.01},
            {"source": "c_mktsegment", "type": "binary", "role": "gender", "mapping": {"BUILDING": 0, "MACHINERY": 1}},
            {"source": "c_nationkey", "type": "binary", "mapping": {i: int(i < 5) for i in range(25)}},
        ],
        "cleaning": {"drop_rows_where": [{"column": "c_acctbal", "operator": "lt", "value": 0}]},
    }
)
PROFILES = [CUSTOMER, EVENTS, ORDERS]
KEY = {"customer": "c_custkey", "events": "event_id", "orders": "o_orderkey"}


def _row_level(df: DataFrame, p: DatasetProfile) -> DataFrame:
    """The clean plan's operators that need no other row, with the encoded label."""
    return labelled(row_level(df, p), p.target)


def _silver(t, p: DatasetProfile) -> DataFrame:
    return keys.numbered_by(_row_level(t(p.name), p), "source_record_num", KEY[p.name])


def _first_id(t, name: str) -> int:
    """A dataset's first patient_record_id: ids run on over datasets in order of their names."""
    before = [_row_level(t(p.name), p).agg(F.count("*").alias("n")) for p in PROFILES if p.name < name]
    return 1 + (reduce(DataFrame.unionAll, before).agg(F.sum("n")).first()[0] if before else 0)


def _patients(t) -> DataFrame:
    """All datasets at once: their key columns are sorted and numbered in one go."""
    rows = [gold.patient_rows(_row_level(t(p.name), p), p, i).withColumn("key", F.col(KEY[p.name]).cast("long")) for i, p in enumerate(PROFILES, 1)]
    whole = reduce(DataFrame.unionAll, [r.select("dataset_id", "key", "age", "gender_id") for r in rows])
    return gold.patient_records(keys.numbered_by(whole, "patient_record_id", "dataset_id", "key"))


def _bracket_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} < 18 THEN '0-17' WHEN {v} < 40 THEN '18-39' WHEN {v} < 60 THEN '40-59' WHEN {v} < 80 THEN '60-79' ELSE '80+' END"


_PRIORITY_SQL = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END"
_CLEAN_SQL = f"""
    cu AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_custkey, c_acctbal * 0.01 AS age, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS g, CASE WHEN c_nationkey < 5 THEN 1 ELSE 0 END AS label FROM customer WHERE NOT c_acctbal < 0),
    ev AS (SELECT row_number() OVER (ORDER BY event_id) AS n, event_id, CAST(user_id AS DOUBLE) AS age, value, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events WHERE lower(event_type) <> 'error'),
    od AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey, o_custkey, o_totalprice * 0.0002 AS age, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS g, {_PRIORITY_SQL} AS label FROM orders),
    offsets AS (SELECT (SELECT count(*) FROM cu) AS c, (SELECT count(*) FROM ev) AS e),
    patient AS (
        SELECT CAST(n AS BIGINT) AS patient_record_id, 1 AS snapshot_id, 1 AS dataset_id, CAST(n AS BIGINT) AS source_record_num, age, CAST(g AS INTEGER) AS gender_id FROM cu
        UNION ALL SELECT CAST(n + c AS BIGINT), 1, 2, CAST(n AS BIGINT), age, -1 FROM ev, offsets
        UNION ALL SELECT CAST(n + c + e AS BIGINT), 1, 3, CAST(n AS BIGINT), age, CAST(g AS INTEGER) FROM od, offsets)
"""


# 2.1 sources
@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def scan_filter_project(t, spark):
    return t("orders").filter("o_totalprice > 200000 and o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price, "
    "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority || ', \"' || o_orderstatus || '\"' END AS note FROM orders"
)
def csv_scan(t, spark):
    """A file with quotes, delimiters in cells and tokens for missing values, written and read back with types."""
    price = F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_totalprice").cast("string"))
    note = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "n/a").otherwise(F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')))
    folder = shared_folder(spark, "orders_csv")
    t("orders").select("o_orderkey", price.alias("price"), note.alias("note")).write.options(header=True, quote='"', escape='"').csv(folder)
    return read_delimited(spark, folder, ",", ["?"])


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '?') THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def na_tokens(t, spark):
    return t("orders").select("o_orderkey", na_to_null(F.col("o_orderpriority"), ["4-NOT SPECIFIED", "?"]).alias("priority"))


@query(
    "WITH cells AS (SELECT 'p_name' AS col, p_name AS v FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'p_retailprice', CAST(p_retailprice AS VARCHAR) FROM part) "
    "SELECT col, count(v) AS n, count(TRY_CAST(v AS DOUBLE)) AS numbers, CAST(count(*) FILTER (regexp_full_match(v, '[+-]?[0-9]+')) AS BIGINT) AS whole FROM cells GROUP BY col"
)
def infer_types(t, spark):
    """What type inference counts of each text column: cells, numbers, whole numbers."""
    text = t("part").select(*[F.col(c).cast("string").alias(c) for c in ("p_name", "p_size", "p_retailprice")])
    got = type_counts(text).first()
    return spark.createDataFrame([(c, got[f"n{i}"], got[f"d{i}"], got[f"w{i}"]) for i, c in enumerate(text.columns)], "col string, n long, numbers long, whole long")


# 2.2 row-level transforms
@query("SELECT doc_id, lang AS clean FROM documents")
def strip_whitespace(t, spark):
    return t("documents").select("doc_id", strip(F.concat(F.lit("   "), "lang", F.lit("\t \n"))).alias("clean"))


def _drop(rule: DropRule, table: str, *columns: str):
    return lambda t, spark: ops.drop_rows(t(table), rule).select(*columns)


for _name, _rule, _table, _columns, _sql in [
    ("drop_rows_equals", DropRule("event_type", "equals", "error"), "events", ("event_id", "event_type"), "event_type = 'error'"),
    ("drop_rows_in", DropRule("event_type", "in", ["error", "click"]), "events", ("event_id", "event_type"), "event_type IN ('error', 'click')"),
    ("drop_rows_lt", DropRule("c_acctbal", "lt", 0), "customer", ("c_custkey", "c_acctbal"), "c_acctbal < 0"),
    ("drop_rows_gt", DropRule("c_acctbal", "gt", 5000), "customer", ("c_custkey", "c_acctbal"), "c_acctbal > 5000"),
    ("drop_rows_ci", DropRule("event_type", "equals", "ERROR", True), "events", ("event_id", "event_type"), "lower(event_type) = 'error'"),
]:
    _f = _drop(_rule, _table, *_columns)
    _f.__name__ = _name
    query(f"SELECT {', '.join(_columns)} FROM {_table} WHERE NOT COALESCE({_sql}, FALSE)")(_f)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def drop_columns(t, spark):
    return t("orders").drop("o_orderstatus", "o_orderdate")


@query("SELECT o_orderkey, round(o_totalprice * 0.0002, 9) AS scaled FROM orders")
def scale_numeric(t, spark):
    return ops.scale(t("orders"), "o_totalprice", 0.0002).select("o_orderkey", F.round("o_totalprice", 9).alias("scaled"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE o_orderstatus END AS status FROM orders")
def value_mapping(t, spark):
    return t("orders").select("o_orderkey", ops.map_values(F.col("o_orderstatus"), STRING, {"F": 0, "O": 1, 1: 7}).alias("status"))


@query("SELECT doc_id, CAST(CASE quality WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE quality END AS BIGINT) AS swapped FROM labels")
def value_mapping_swap(t, spark):
    return t("labels").select("doc_id", ops.map_values(F.col("quality"), INT, {1: 0, 0: 1}).alias("swapped"))


@query("SELECT p_partkey, CASE WHEN p_size <= 13 THEN CASE p_size WHEN 1 THEN 21 ELSE 17 + 5 * CAST(p_size AS BIGINT) END ELSE CAST(p_size AS BIGINT) END AS years FROM part")
def code_midpoint_map(t, spark):
    return t("part").select("p_partkey", ops.map_values(F.col("p_size"), INT, {1: 21} | {i: 17 + 5 * i for i in range(2, 14)}).alias("years"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_band FROM part")
def hierarchy_bands(t, spark):
    return ops.add_bands(t("part"), "p_size", "size_band", [Band("small", 10), Band("middle", 30), Band("large", float("inf"))]).select("p_partkey", "size_band")


@query(f"SELECT c_custkey, {_bracket_sql('c_acctbal * 0.01')} AS bracket FROM customer")
def age_bracket(t, spark):
    return t("customer").select("c_custkey", gold.age_bracket(F.col("c_acctbal") * 0.01).alias("bracket"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE NULL END AS label FROM orders")
def label_encode(t, spark):
    return t("orders").select("o_orderkey", ops.encode_label(F.col("o_orderstatus"), STRING, TargetSpec("o_orderstatus", "F", "O")).alias("label"))


@query(f"SELECT o_orderkey, {_PRIORITY_SQL} AS label FROM orders")
def label_binarize(t, spark):
    df = ops.apply_mapping(t("orders"), next(c for c in ORDERS.columns if c.source == "o_orderpriority"))
    return df.select("o_orderkey", ops.encode_label(F.col("o_orderpriority"), STRING, ORDERS.target).alias("label"))


_ODD = "SELECT 'p_brand' AS col, p_brand AS value FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') UNION SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_size NOT IN (1, 2) UNION SELECT 'p_type', p_type FROM part WHERE p_type <> 'none'"


@query(f"WITH odd AS ({_ODD}) SELECT col, value FROM odd QUALIFY row_number() OVER (PARTITION BY col ORDER BY value) <= 20")
def domain_violations(t, spark):
    specs = [ColumnSpec("p_brand", "nominal", domain=["Brand#11", "Brand#12"]), ColumnSpec("p_size", "ordinal", domain=[1, 2]), ColumnSpec("p_type", "nominal", domain=["none"])]
    found = ops.domain_violations(t("part"), specs)
    return spark.createDataFrame([(c, v) for c, vs in found.items() for v in vs], "col string, value string")


def _holed(t) -> DataFrame:
    """Events whose value is missing where the type is error."""
    return t("events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


_HOLED = "(SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


@query(f"SELECT 'event_id' AS col, count(*) FILTER (event_id IS NULL) AS nulls FROM {_HOLED} UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM {_HOLED}")
def null_audit(t, spark):
    return spark.createDataFrame(list(ops.null_counts(_holed(t).select("event_id", "value")).items()), "col string, nulls long")


@query(f"SELECT count(*) AS n, CAST(4 AS BIGINT) AS columns, count(*) FILTER (value IS NULL) AS missing FROM {_HOLED}")
def missing_cells(t, spark):
    return stats.missing_cells(_holed(t).select("event_id", "user_id", "event_type", "value")).withColumnRenamed("rows", "n")


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, round(100.0 * count(*) FILTER ({c} IS NULL) / greatest(count(*), 1), 4) AS null_pct FROM {_HOLED}" for c in ("event_id", "user_id", "value", "event_type")))
def null_pct(t, spark):
    records = column_records(_holed(t).drop("ts", "props"), EVENTS)
    return spark.createDataFrame([(r["source_column"], r["null_pct"]) for r in records if r["declared_type"] and r["dtype"] != "absent"], "col string, null_pct double")


@query("SELECT event_id, CAST(trunc(value) AS INTEGER) AS as_binary, value AS as_numeric, CAST(user_id AS VARCHAR) AS as_nominal, TRY_CAST(event_type AS DOUBLE) AS text_as_numeric, CAST(event_id AS BIGINT) AS as_identifier FROM events")
def normalize_values(t, spark):
    pick = [("value", DOUBLE, "binary", "as_binary"), ("value", DOUBLE, "numeric", "as_numeric"), ("user_id", LONG, "nominal", "as_nominal"), ("event_type", STRING, "numeric", "text_as_numeric"), ("event_id", LONG, "identifier", "as_identifier")]
    return t("events").select("event_id", *[ops.normalise(F.col(c), k, a).alias(n) for c, k, a, n in pick])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS gender_id FROM orders")
def gender_clamp(t, spark):
    code = ops.map_values(F.col("o_orderstatus"), STRING, {"F": 0, "O": 1})
    return t("orders").select("o_orderkey", gold.clamp_gender(code, STRING).alias("gender_id"))


# 2.6 imputation
@query(f"SELECT event_id, coalesce(value, (SELECT median(value) FROM {_HOLED})) AS value FROM {_HOLED}")
def impute_median(t, spark):
    return ops.impute_medians(_holed(t), ["value"]).select("event_id", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' ELSE o_orderpriority END AS priority FROM orders")
def impute_constant(t, spark):
    df = replace_tokens(t("orders"), ["4-NOT SPECIFIED"])
    return ops.impute_constant(df, "o_orderpriority", "Unknown").select("o_orderkey", F.col("o_orderpriority").alias("priority"))


_RULE = {"strategy": "grouped_median", "group_source_column": "user_id", "group_bands": _bands(("low", 50), ("middle", 100), ("high", ".inf")), "fallback": "global_median"}
_GROUPED = f"WITH b AS (SELECT *, CASE WHEN user_id < 50 THEN 'low' WHEN user_id < 100 THEN 'middle' ELSE 'high' END AS band FROM {_HOLED}), s AS (SELECT band, median(value) AS median, count(*) FILTER (value IS NULL) AS missing FROM b GROUP BY band) "


@query(_GROUPED + "SELECT event_id, coalesce(value, median) AS value FROM b JOIN s USING (band)")
def impute_grouped_median(t, spark):
    return ops.impute_grouped_median(_holed(t), "value", _RULE)[0].select("event_id", "value")


@query(_GROUPED + "SELECT l.band, round(median, 3) AS median, coalesce(missing, 0) AS missing FROM (VALUES ('low'), ('middle'), ('high')) l(band) LEFT JOIN s USING (band)")
def impute_stats(t, spark):
    return spark.createDataFrame([(r["band"], r["median"], r["missing"]) for r in ops.impute_grouped_median(_holed(t), "value", _RULE)[1]], "band string, median double, missing long")


def _grouped(t) -> DataFrame:
    bands = [Band("low", 50), Band("middle", 100), Band("high", float("inf"))]
    return ops.group_stats(_holed(t), "value", ops.band(F.col("user_id").cast("double"), bands))


@query(_GROUPED + "SELECT band, median FROM s")
def grouped_median(t, spark):
    return _grouped(t).select("band", "median")


@query(_GROUPED + "SELECT band, missing FROM s")
def grouped_missing(t, spark):
    return _grouped(t).select("band", "missing")


# 2.5 aggregates
@query("SELECT count(*) AS n, CAST(3 AS BIGINT) AS columns FROM labels")
def profile_counts(t, spark):
    return stats.missing_cells(t("labels")).select(F.col("rows").alias("n"), "columns")


@query("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS duplicates FROM events")
def duplicate_rows(t, spark):
    return stats.duplicate_rows(t("events").select("user_id", "event_type"))


@query("SELECT 'user_id' AS col, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events UNION ALL SELECT 'value', count(DISTINCT value) FROM events")
def distinct_counts(t, spark):
    return spark.createDataFrame([(c, s["distinct"]) for c, s in stats.column_counts(t("events"), ["user_id", "event_type", "value"]).items()], "col string, n long")


@query(f"SELECT min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, median(value) AS median, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM {_HOLED}")
def numeric_stats(t, spark):
    df = stats.numeric_stats(_holed(t), "value")
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q75")})


@query("SELECT count(p_retailprice) AS n, round(quantile_cont(p_retailprice, 0.05), 6) AS p5, round(median(p_retailprice), 6) AS median, round(quantile_cont(p_retailprice, 0.95), 6) AS p95 FROM part")
def fingerprint_stats(t, spark):
    return stats.fingerprint_stats(t("part"), "p_retailprice").withColumns({c: F.round(c, 6) for c in ("p5", "median", "p95")})


_TOP = "WITH c AS (SELECT 'p_brand' AS col, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), g AS (SELECT col, value, count(*) AS n FROM c GROUP BY col, value), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM g) "


@query(_TOP + "SELECT col, value, n, rank FROM r WHERE rank <= 20")
def top_values(t, spark):
    return stats.top_values(t("part"), ["p_brand", "p_type"]).withColumnRenamed("column", "col")


@query(_TOP + "SELECT col, value FROM r WHERE rank = 1")
def mode_value(t, spark):
    return stats.top_values(t("part"), ["p_brand", "p_type"], 1).select(F.col("column").alias("col"), "value")


@query("SELECT 'p_name' AS col, p_name AS value, row_number() OVER (ORDER BY p_partkey) AS rank FROM part QUALIFY rank <= 5 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), row_number() OVER (ORDER BY p_partkey) AS rank FROM part QUALIFY rank <= 5")
def sample_values(t, spark):
    return stats.sample_values(t("part"), ["p_name", "p_size"], "p_partkey").withColumnRenamed("column", "col")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def target_distribution(t, spark):
    return stats.value_counts(t("orders"), "o_orderpriority")


@query(f"SELECT sum({_PRIORITY_SQL})::BIGINT AS positive, sum(1 - {_PRIORITY_SQL})::BIGINT AS negative FROM orders")
def label_counts(t, spark):
    return _row_level(t("orders"), ORDERS).agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


@query("SELECT count(*) FILTER (event_type = 'error') AS matched, count(*) FILTER (event_type = 'error' AND value > 100) AS matched_positive FROM events")
def drop_rule_counts(t, spark):
    df, rule = t("events"), DropRule("event_type", "equals", "error")
    hit = ops.drop_condition(df, rule)
    return df.agg(F.count_if(hit).alias("matched"), F.count_if(hit & (F.col("value") > 100)).alias("matched_positive"))


@query(f"SELECT {_PRIORITY_SQL} AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def label_group_by(t, spark):
    return gold.label_groups(_row_level(t("orders"), ORDERS)).orderBy("label")


# 2.3 keys
@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS source_record_num FROM orders")
def source_record_num(t, spark):
    return keys.numbered_by(t("orders").select("o_orderkey"), "source_record_num", "o_orderkey")


@query(f"WITH {_CLEAN_SQL} SELECT dataset_id, min(patient_record_id) AS first_id, max(patient_record_id) AS last_id, count(*) AS n FROM patient GROUP BY dataset_id")
def patient_record_id(t, spark):
    return _patients(t).groupBy("dataset_id").agg(F.min("patient_record_id").alias("first_id"), F.max("patient_record_id").alias("last_id"), F.count("*").alias("n"))


# 1.4 gold tables
@query(f"WITH {_CLEAN_SQL} SELECT v.*, count(patient_record_id) AS patients FROM (VALUES (1, 'customer', 'general', 'fact_customer'), (2, 'events', 'general', 'fact_events'), (3, 'orders', 'general', 'fact_orders')) v(dataset_id, dataset_name, domain, fact_table) LEFT JOIN patient USING (dataset_id) GROUP BY ALL")
def dim_dataset(t, spark):
    return _with_patients(t, gold.dim_dataset(spark, PROFILES).select("dataset_id", "dataset_name", "domain", "fact_table"), "dataset_id")


def _with_patients(t, dim: DataFrame, key: str) -> DataFrame:
    """A dimension with the number of patient records of each row."""
    counts = _patients(t).groupBy(key).agg(F.count("*").alias("patients"))
    return dim.join(counts, key, "left").withColumn("patients", F.coalesce("patients", F.lit(0)))


@query(f"WITH {_CLEAN_SQL}, b AS (SELECT {_bracket_sql('age')} AS age_bracket FROM patient) SELECT v.*, count(b.age_bracket) AS patients FROM (VALUES ('0-17', 1, CAST(0 AS DOUBLE), CAST(17.999 AS DOUBLE)), ('18-39', 2, 18, 39.999), ('40-59', 3, 40, 59.999), ('60-79', 4, 60, 79.999), ('80+', 5, 80, NULL)) v(age_bracket, sort_order, lower_age, upper_age) LEFT JOIN b USING (age_bracket) GROUP BY ALL")
def dim_age_bracket(t, spark):
    return _with_patients(t, gold.dim_age_bracket(spark), "age_bracket")


@query(f"WITH {_CLEAN_SQL} SELECT v.*, count(patient_record_id) AS patients FROM (VALUES (0, 'Female'), (1, 'Male'), (-1, 'Unknown')) v(gender_id, gender_code) LEFT JOIN patient USING (gender_id) GROUP BY ALL")
def dim_gender(t, spark):
    return _with_patients(t, gold.dim_gender(spark), "gender_id")


@query(f"WITH {_CLEAN_SQL} SELECT patient_record_id, snapshot_id, dataset_id, source_record_num, round(age, 9) AS age, gender_id, {_bracket_sql('age')} AS age_bracket FROM patient")
def dim_patient_record(t, spark):
    return _patients(t).withColumn("age", F.round("age", 9))


_FACT_SQL = f"WITH {_CLEAN_SQL} SELECT CAST(n AS BIGINT) AS fact_id, CAST(n + c + e AS BIGINT) AS patient_record_id, 1 AS snapshot_id, 3 AS dataset_id, o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, CASE WHEN o_custkey < 500 THEN 'low' ELSE 'high' END AS customer_band, label FROM od, offsets"


@query(_FACT_SQL)
def fact_build(t, spark):
    return gold.fact(_silver(t, ORDERS), ORDERS, 3, _first_id(t, "orders"))


@query(_FACT_SQL.replace("1 AS snapshot_id, 3 AS dataset_id, o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, ", ""))
def fact_scan(t, spark):
    """Two columns, two keys and a band of a stored fact table."""
    folder = shared_folder(spark, "fact_orders")
    gold.fact(_silver(t, ORDERS), ORDERS, 3, _first_id(t, "orders")).write.parquet(folder)
    return spark.read.parquet(folder).select("fact_id", "patient_record_id", "customer_band", "label")


_VIEW_SQL = f"""WITH {_CLEAN_SQL}
    SELECT patient_record_id, snapshot_id, source_record_num, round(p.age, 9) AS age, CASE gender_id WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Unknown' END AS gender, {_bracket_sql('p.age')} AS age_bracket,
           o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, CASE WHEN o_custkey < 500 THEN 'low' ELSE 'high' END AS customer_band, label AS orders_label
    FROM patient p JOIN od ON od.n = p.source_record_num WHERE dataset_id = 3"""


def _full(t, spark) -> DataFrame:
    """Fact and patients are stored by patient_record_id, as the build stores them, so the view joins them where they are."""
    first, silver, stored = _first_id(t, "orders"), _silver(t, ORDERS), uuid.uuid4().hex
    parts = {"fact": gold.fact(silver, ORDERS, 3, first), "patient": gold.dim_patient_record(silver, ORDERS, 3, first)}
    for name, df in parts.items():
        gold.stored_by_key(df, f"{name}_{stored}", shared_folder(spark, name), "patient_record_id", BUCKETS)
    return gold.full_view(spark.table(f"fact_{stored}"), spark.table(f"patient_{stored}"), gold.dim_gender(spark), gold.dim_dataset(spark, PROFILES), ORDERS)


@query(_VIEW_SQL)
def vw_full(t, spark):
    return _full(t, spark).withColumn("age", F.round("age", 9))


@query(f"WITH {_CLEAN_SQL} SELECT coalesce(g, 'Unknown') AS gender, count(*) AS n FROM patient LEFT JOIN (VALUES (0, 'Female'), (1, 'Male')) v(id, g) ON v.id = gender_id GROUP BY 1")
def left_join_gender(t, spark):
    known = gold.dim_gender(spark).filter("gender_id >= 0")
    return _patients(t).join(F.broadcast(known), "gender_id", "left").groupBy(F.coalesce("gender_code", F.lit("Unknown")).alias("gender")).agg(F.count("*").alias("n"))


@query(
    f"WITH {_CLEAN_SQL} "
    + " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS total_records, sum(label)::BIGINT AS positive_cases, round(100.0::DOUBLE * sum(label) / nullif(count(*), 0), 2) AS positive_rate_pct FROM {v}" for n, v in (("customer", "cu"), ("events", "ev"), ("orders", "od")))
)
def vw_summary(t, spark):
    return gold.summary({p.name: _row_level(t(p.name), p) for p in PROFILES})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def fk_check_anti(t, spark):
    return gold.orphans(t("orders").select("o_orderkey", "o_custkey"), t("customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("SELECT o_orderkey AS snapshot_id, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def latest_snapshot(t, spark):
    return gold.latest_snapshot(t("orders").select(F.col("o_orderkey").alias("snapshot_id"), "o_totalprice"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def topk(t, spark):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


# 2.9 inference
def _kind_sql(c: str, number: bool, whole: bool) -> str:
    text = f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 'nominal/HIGH' ELSE 'nominal/LOW' END"
    digits = f"CASE WHEN {whole} AND count(DISTINCT {c}) <= 8 THEN 'ordinal/MEDIUM' ELSE 'numeric/HIGH' END"
    known = f"WHEN count(DISTINCT {c}) = count({c}) AND count({c}) > 50 THEN 'identifier/HIGH' " if whole or not number else ""
    return f"SELECT '{c}' AS col, CASE {known}WHEN count(DISTINCT {c}) = 2 THEN 'binary/HIGH' ELSE {digits if number else text} END AS kind FROM part"


@query(" UNION ALL ".join(_kind_sql(*c) for c in (("p_partkey", True, True), ("p_retailprice", True, False), ("p_size", True, True), ("p_brand", False, False), ("p_name", False, False))))
def classify_columns(t, spark):
    columns = engine.describe(t("part").select("p_partkey", "p_retailprice", "p_size", "p_brand", "p_name"))
    return spark.createDataFrame([(n, "/".join(engine.classify(c)[:2])) for n, c in columns.items()], "col string, kind string")


_SMALL = "SELECT 0 AS place, 'doc_id' AS col, count(DISTINCT doc_id) AS n FROM labels UNION ALL SELECT 1, 'quality', count(DISTINCT quality) FROM labels UNION ALL SELECT 2, 'toxic', count(DISTINCT toxic) FROM labels"


@query(f"SELECT col, 'MEDIUM' AS confidence, n || ' distinct values' AS reason FROM ({_SMALL}) WHERE n BETWEEN 2 AND 5 ORDER BY n, place DESC LIMIT 1")
def target_candidates(t, spark):
    return spark.createDataFrame([engine.detect_target(engine.describe(t("labels").select("doc_id", "quality", "toxic")))], "col string, confidence string, reason string")


@query("SELECT DISTINCT n_regionkey AS value, CASE WHEN n_regionkey > 0 THEN 1 ELSE 0 END AS code FROM nation")
def target_encoding(t, spark):
    _, mapping = engine.target_encoding(engine.describe(t("nation").select("n_regionkey"))["n_regionkey"].listed)
    return spark.createDataFrame(list(mapping.items()), f"value {t('nation').schema['n_regionkey'].dataType.simpleString()}, code int")


_WINDOWS = [(name, *low, *high, *middle) for name, _, _, low, high, middle in RANGES]
_RANGED = "SELECT 'o_totalprice' AS col, o_totalprice * 0.001 AS v FROM orders UNION ALL SELECT 'p_size', p_size FROM part UNION ALL SELECT 'user_id', user_id FROM events"


@query(
    f"WITH c AS ({_RANGED}), q AS (SELECT col, quantile_cont(v::DOUBLE, 0.05) AS lo, quantile_cont(v::DOUBLE, 0.95) AS hi, median(v::DOUBLE) AS mid FROM c GROUP BY col), "
    f"w(place, name, a, b, c, d, e, f) AS (VALUES {', '.join(str((i, *w)) for i, w in enumerate(_WINDOWS))}) "
    "SELECT col, arg_min(name, place) AS name FROM q LEFT JOIN w ON lo BETWEEN a AND b AND hi BETWEEN c AND d AND mid BETWEEN e AND f GROUP BY col"
)
def range_matching(t, spark):
    given = {"o_totalprice": t("orders").select((F.col("o_totalprice") * 0.001).alias("o_totalprice")), "p_size": t("part").select("p_size"), "user_id": t("events").select("user_id")}
    found = {c: engine.match_range(engine.describe(df)[c]) for c, df in given.items()}
    return spark.createDataFrame([(c, w and w[0]) for c, w in found.items()], "col string, name string")


@query("SELECT list_sort(list(DISTINCT event_type)) AS domain FROM events")
def domain_inference(t, spark):
    column = engine.describe(t("events").select("event_type"))["event_type"]
    return spark.createDataFrame([(column.listed,)], "domain array<string>")


@query("WITH s AS (SELECT min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders WHERE o_orderstatus <> 'P') SELECT lo AS status, 0 AS code FROM s UNION ALL SELECT hi, 1 FROM s")
def propose_mapping(t, spark):
    column = engine.describe(t("orders").filter("o_orderstatus <> 'P'").select("o_orderstatus"))["o_orderstatus"]
    return spark.createDataFrame(sorted(engine.propose_mapping(column)[0].items()), "status string, code int")


@query("SELECT CASE WHEN max(o_totalprice * 0.05) > 150 AND max(o_totalprice * 0.05) < 50000 THEN round(1 / 365.25, 9) END AS factor FROM orders")
def age_unit_check(t, spark):
    column = engine.describe(t("orders").select((F.col("o_totalprice") * 0.05).alias("age")))["age"]
    found = engine.age_unit(column)
    return spark.createDataFrame([(round(found[0], 9) if found and found[0] else None,)], "factor double")


@query("SELECT 'gender' AS col, count(DISTINCT o_orderstatus) || ' genders: rare ones may need a drop rule' AS reason FROM orders HAVING count(DISTINCT o_orderstatus) > 2")
def gender_check(t, spark):
    columns = engine.describe(t("orders").select(F.col("o_orderstatus").alias("gender"), (F.col("o_totalprice") > 100000).cast("int").alias("label")))
    found = engine.infer_columns(columns)[3]
    return spark.createDataFrame([(d.column, d.reason) for d in found if (d.column, d.field) == ("gender", "drop_rows_where")], "col string, reason string")


_SURE = {"1-URGENT": engine.HIGH, "2-HIGH": engine.MEDIUM}


@query("SELECT o_orderstatus AS col, ['HIGH', 'MEDIUM', 'LOW'][1 + min(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END)] AS confidence FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def effective_confidence(t, spark):
    """The best decision of each column (here a status for each), without the dropped one (P)."""
    pairs = t("orders").select("o_orderstatus", "o_orderpriority").distinct().collect()  # a row for each status and priority
    decisions = [engine.Decision(r[0], "type", None, _SURE.get(r[1], engine.LOW), "") for r in pairs]
    draft = engine.Draft({"columns": [{"source": "P", "drop": True}]}, decisions)
    return spark.createDataFrame([(c, sure) for (c, _), sure in draft.effective().items()], "col string, confidence string")


_ROLES = {"even": [1.0 if i % 2 == 0 else 0.0 for i in range(64)], "odd": [1.0 if i % 2 else 0.0 for i in range(64)]}


@query(
    "WITH d AS (SELECT vec_id, list_sum(list_transform(range(1, 65, 2), lambda i: embedding[i]::DOUBLE)) AS even, list_sum(list_transform(range(2, 65, 2), lambda i: embedding[i]::DOUBLE)) AS odd, "
    "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(32) AS norm FROM embeddings) "
    "SELECT vec_id, CASE WHEN even >= odd THEN 'even' ELSE 'odd' END AS role, round(greatest(even, odd) / norm, 4) AS cosine, round(abs(even - odd) / norm, 4) AS margin FROM d"
)
def role_similarity(t, spark):
    roles, compare = _ROLES, providers.nearest

    def run(batches):
        for b in batches:
            found = compare(np.array(b["embedding"].tolist(), float), list(roles), np.array(list(roles.values())))
            yield pd.DataFrame({"vec_id": b["vec_id"], "role": [r for r, _, _ in found], "cosine": [round(c, 4) for _, c, _ in found], "margin": [round(m, 4) for _, _, m in found]})

    return t("embeddings").select("vec_id", "embedding").mapInPandas(run, f"vec_id {t('embeddings').schema['vec_id'].dataType.simpleString()}, role string, cosine double, margin double")


# 2.11 governance
@query(f"WITH {_CLEAN_SQL} SELECT 'raw' AS stage, count(*) AS row_count, CAST(NULL AS BIGINT) AS positive_count FROM events UNION ALL SELECT 'cleaned', count(*), sum(label)::BIGINT FROM ev")
def lineage_counts_query(t, spark):
    return lineage_counts(t("events"), _row_level(t("events"), EVENTS), "label")


QUERIES["lineage_counts"], ORACLES["lineage_counts"] = QUERIES.pop("lineage_counts_query"), ORACLES.pop("lineage_counts_query")


@query(
    f"WITH {_CLEAN_SQL} SELECT 'raw_rows' AS metric_name, count(*)::DOUBLE AS metric_value, 'PASS' AS status FROM customer UNION ALL SELECT 'cleaned_rows', count(*), 'PASS' FROM cu "
    "UNION ALL SELECT 'cleaned_missing_cells', 0, 'PASS' UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM customer) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)), 'INFO' "
    "UNION ALL SELECT 'positive_count', sum(label), 'PASS' FROM cu UNION ALL SELECT 'negative_count', sum(1 - label), 'PASS' FROM cu"
)
def audit_rows_query(t, spark):
    _, log = clean(t("customer"), CUSTOMER)
    rows = audit_rows([CUSTOMER], {"customer": log}, {}, 1)
    return spark.createDataFrame([(r[4], r[5], r[6]) for r in rows], "metric_name string, metric_value double, status string")


QUERIES["audit_rows"], ORACLES["audit_rows"] = QUERIES.pop("audit_rows_query"), ORACLES.pop("audit_rows_query")


@query("SELECT c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation, count(*) AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS positive FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup_band_label(t, spark):
    df = t("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_acctbal") < 0).cast("int").alias("label"))
    return gold.band_rollup(df, "segment", "nation")


from . import build_queries  # noqa: E402, F401  its queries join the catalogue
