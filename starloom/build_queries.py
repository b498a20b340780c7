"""Queries over what the build and the scaffold write: each builds from the given tables, then reads the stored outputs back."""

from __future__ import annotations

from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inference import emit, engine
from .operators import stats
from .plans.profile import ProfileLoader, parse_profile
from .plans.warehouse import Snapshot, Warehouse, catalog
from .queries import _CLEAN_SQL, _HOLED, CUSTOMER, EVENTS, ORACLES, ORDERS, PROFILES, QUERIES, _holed, query, shared_folder
from .sources.delimited import read_delimited

_BUILT: dict[tuple[str, str], str] = {}


def built(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The warehouse of the three profiles over these tables; a session builds it once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        house = Warehouse(spark, sf_dir, shared_folder(spark, "warehouse"))
        house.build(PROFILES)
        _BUILT[key] = house.output
    return Warehouse(spark, sf_dir, _BUILT[key]).latest()


def build_query(sql: str) -> Callable:
    """Register a function of the published snapshot and the session."""

    def add(f: Callable[[Snapshot, SparkSession], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(built(spark, sf_dir), spark)
        ORACLES[f.__name__] = sql
        return f

    return add


_NUMERIC = {"c_custkey", "c_acctbal", "c_nationkey", "event_id", "user_id", "value", "o_orderkey", "o_custkey", "o_totalprice"}
_COLUMNS = [(p.name, c.source, c.type) for p in PROFILES for c in p.columns]
_DICTIONARY = " UNION ALL ".join(
    f"SELECT {i} AS dictionary_id, '{t}' AS dataset_name, '{c}' AS source_column, '{kind}' AS declared_type, '{'numeric' if c in _NUMERIC else 'categorical'}' AS inferred_type, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {t}"
    for i, (t, c, kind) in enumerate(_COLUMNS, 1)
)


@build_query(_DICTIONARY)
def build_dictionary(snapshot, spark):
    """The data dictionary of the stored warehouse, with its running ids."""
    return snapshot.table("metadata_data_dictionary").select("dictionary_id", "dataset_name", "source_column", "declared_type", "inferred_type", "null_count", "distinct_count")


_RAW = {"customer": "c_nationkey < 5", "events": "event_type = 'purchase'", "orders": "o_orderpriority IN ('1-URGENT', '2-HIGH')"}
_STAGES = " UNION ALL ".join(
    f"SELECT {3 * i + k} AS lineage_id, '{t}' AS dataset_name, '{stage}' AS pipeline_stage, count(*) AS row_count, CAST(count(*) FILTER ({hit}) AS BIGINT) AS positive_count, CAST(count(*) FILTER (NOT {hit}) AS BIGINT) AS negative_count FROM {source}"
    for i, (t, view) in enumerate((("customer", "cu"), ("events", "ev"), ("orders", "od")))
    for k, stage, source, hit in ((1, "raw", t, f"({_RAW[t]})"), (2, "cleaned", view, "(label = 1)"), (3, "warehouse", view, "(label = 1)"))
)


@build_query(f"WITH {_CLEAN_SQL} {_STAGES}")
def build_lineage(snapshot, spark):
    """The lineage rows: raw, cleaned and stored rows and labels of each dataset."""
    return snapshot.table("metadata_lineage").select("lineage_id", "dataset_name", "pipeline_stage", "row_count", "positive_count", "negative_count")


_AUDIT = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset_name, 'raw_rows' AS metric_name, count(*)::DOUBLE AS metric_value, 'PASS' AS status FROM {t} UNION ALL SELECT '{t}', 'cleaned_rows', count(*), 'PASS' FROM {v} UNION ALL SELECT '{t}', 'cleaned_missing_cells', 0, 'PASS' "
    f"UNION ALL SELECT '{t}', 'duplicate_rows', (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})), 'INFO' UNION ALL SELECT '{t}', 'positive_count', sum(label), 'PASS' FROM {v} UNION ALL SELECT '{t}', 'negative_count', sum(1 - label), 'PASS' FROM {v}"
    for t, v in (("customer", "cu"), ("events", "ev"), ("orders", "od"))
)


@build_query(f"WITH {_CLEAN_SQL}, a AS ({_AUDIT}) SELECT * FROM a")
def build_audit(snapshot, spark):
    """The audit log of the stored warehouse."""
    return snapshot.table("etl_audit_log").select("dataset_name", "metric_name", "metric_value", "status")


@build_query(
    f"WITH {_CLEAN_SQL} SELECT 'dim_patient_record' AS name, count(*) AS n, count(DISTINCT patient_record_id) AS keys FROM patient UNION ALL SELECT 'fact_customer', count(*), count(DISTINCT c_custkey) FROM cu "
    "UNION ALL SELECT 'fact_events', count(*), count(DISTINCT event_id) FROM ev UNION ALL SELECT 'fact_orders', count(*), count(DISTINCT o_orderkey) FROM od"
)
def build_gold(snapshot, spark):
    """Rows and different keys of the stored gold tables."""
    one = lambda n: snapshot.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.count_distinct("patient_record_id").alias("keys"))
    first, *rest = map(one, ("dim_patient_record", "fact_customer", "fact_events", "fact_orders"))
    for df in rest:
        first = first.unionAll(df)
    return first


@build_query(f"WITH {_CLEAN_SQL} SELECT o_orderkey, CASE WHEN o_custkey < 500 THEN 'low' ELSE 'high' END AS customer_band, CAST(label AS BIGINT) AS label FROM od")
def build_csv(snapshot, spark):
    """The cleaned rows as the build's delimited files have them."""
    return read_delimited(spark, snapshot.path("cleaned_csv/orders"), multiline=True).select("o_orderkey", "customer_band", "label")


@build_query(" UNION ALL ".join(f"SELECT '{t}' AS dataset, '{c}' AS source_column, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {t}" for t, c, _ in _COLUMNS))
def build_dictionary_json(snapshot, spark):
    """The same dictionary from the JSON file."""
    kind = "struct<datasets: array<struct<columns: array<struct<dataset: string, source_column: string, null_count: bigint, distinct_count: bigint>>>>>"
    text = spark.read.text(snapshot.path("data_dictionary.json"), wholetext=True)
    return text.select(F.explode(F.flatten(F.transform(F.from_json("value", kind)["datasets"], lambda d: d["columns"]))).alias("c")).select("c.*")


@build_query(
    f"WITH {_CLEAN_SQL} "
    + " UNION ALL ".join(f"SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS raw_rows, count(*) AS cleaned_rows, (SELECT count(*) FROM {t}) - count(*) AS removed_rows, sum(label)::BIGINT AS positive FROM {v}" for t, v in (("customer", "cu"), ("events", "ev"), ("orders", "od")))
)
def build_lineage_json(snapshot, spark):
    """The lineage report from the JSON file."""
    kind = "map<string, struct<raw_rows: bigint, cleaned_rows: bigint, removed_rows_total: bigint, cleaned_target: map<string, bigint>>>"
    told = spark.read.text(snapshot.path("lineage_report.json"), wholetext=True).select(F.explode(F.from_json("value", kind)).alias("dataset", "x"))
    return told.select("dataset", "x.raw_rows", "x.cleaned_rows", F.col("x.removed_rows_total").alias("removed_rows"), F.col("x.cleaned_target")["positive"].alias("positive"))


@build_query(
    f"WITH {_CLEAN_SQL} SELECT 'vw_customer_full' AS name, 'view' AS type, count(*) AS n, sum(label)::BIGINT AS positive FROM cu UNION ALL SELECT 'vw_events_full', 'view', count(*), sum(label)::BIGINT FROM ev "
    "UNION ALL SELECT 'vw_orders_full', 'view', count(*), sum(label)::BIGINT FROM od"
)
def build_views(snapshot, spark):
    """The views that the session's catalogue lists after a build, each read."""
    snapshot.register(PROFILES)
    one = lambda p: spark.table(f"vw_{p.name}_full").agg(F.lit(f"vw_{p.name}_full").alias("name"), F.count("*").alias("n"), F.sum(f"{p.name}_label").alias("positive"))
    rows = one(CUSTOMER).unionAll(one(EVENTS)).unionAll(one(ORDERS))
    return catalog(spark).join(rows, "name")


# The scaffold: a file drawn from orders, whose columns ask for each rule.
_DRAFTED = {
    "order no": "CAST(o_orderkey AS VARCHAR)",
    "Age": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(floor(o_totalprice / 6000) AS INTEGER) + 1 AS VARCHAR) END",
    "sex": "CASE WHEN o_orderstatus = 'F' THEN 'Male' ELSE 'Female' END",
    "kidney": "CASE WHEN o_orderpriority < '3' THEN 'ckd' ELSE 'notckd' END",
    "state": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'open' ELSE 'not open' END",
    "sys_mm_hg": "CAST(90 + o_custkey % 100 AS VARCHAR)",
    "zone": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END",
    "mass": "CAST(12 + o_custkey % 31 AS VARCHAR)",
    "class": "CASE WHEN o_totalprice > 150000 THEN 'yes' ELSE 'no' END",
}


def _draft_sql() -> str:
    cells = ", ".join(f'{sql} AS "{name}"' for name, sql in _DRAFTED.items())
    fixed = {
        "order no": ("CASE WHEN count(DISTINCT \"order no\") = count(*) AND count(*) > 50 THEN 'identifier' END", "NULL", "TRUE", "NULL", "NULL", "NULL", "NULL"),
        "Age": ("'numeric'", "'age'", "FALSE", "NULL", "NULL", "CASE WHEN count(\"Age\") < count(*) THEN 'median' END", "'age_bracket'"),
        "sex": ("'binary'", "'gender'", "FALSE", "'Female=0,Male=1'", "NULL", "NULL", "NULL"),
        "kidney": ("'binary'", "'comorbidity'", "FALSE", "'ckd=1,notckd=0'", "NULL", "NULL", "NULL"),
        "state": ("'binary'", "NULL", "FALSE", "'not open=0,open=1'", "NULL", "NULL", "NULL"),
        "sys_mm_hg": ("'numeric'", "'lab'", "FALSE", "NULL", "NULL", "NULL", "'bp_band'"),
        "zone": ("'nominal'", "NULL", "FALSE", "NULL", "string_agg(DISTINCT zone, ',' ORDER BY zone)", "CASE WHEN count(zone) < count(*) THEN 'constant' END", "NULL"),
        "mass": ("'numeric'", "'lab'", "FALSE", "NULL", "NULL", "NULL", "'bmi_band'"),
        "class": ("'binary'", "NULL", "FALSE", "'no=0,yes=1'", "NULL", "NULL", "NULL"),
    }
    names = ("type", "role", "dropped", "mapping", "domain", "imputation", "band")
    rows = " UNION ALL ".join(f"SELECT '{c}' AS col, " + ", ".join(f"CAST({v} AS {'BOOLEAN' if n == 'dropped' else 'VARCHAR'}) AS {n}" for n, v in zip(names, values, strict=True)) + " FROM f HAVING count(*) > 0" for c, values in fixed.items())
    return f"WITH f AS (SELECT {cells} FROM orders) {rows}"


@query(_draft_sql())
def scaffold_profile(t, spark):
    """A profile drafted from a file, written as YAML, read back as a profile."""
    folder = shared_folder(spark, "orders_draft")
    spark_sql = {c: s.replace("VARCHAR", "STRING") for c, s in _DRAFTED.items()}
    t("orders").selectExpr(*[f"{s} AS `{c}`" for c, s in spark_sql.items()]).write.options(header=True, quote='"', escape='"').csv(folder)
    draft = engine.infer_profile(spark, folder, "orders_draft")
    profile = parse_profile(yaml.load(emit.emit(draft), Loader=ProfileLoader))
    band = {h.source_column: h.new_column for h in profile.hierarchies}
    listed = lambda xs: ",".join(map(str, sorted(xs))) if xs else None
    rows = [(c.source, c.type, c.role, c.drop, listed([f"{k}={v}" for k, v in (c.mapping or {}).items()]), listed(c.domain), (c.imputation or {}).get("strategy"), band.get(c.source)) for c in profile.columns]
    return spark.createDataFrame(rows, "col string, type string, role string, dropped boolean, mapping string, domain string, imputation string, band string")


_SEEN = f"SELECT event_id, value, CASE WHEN event_id % 1500 = 7 THEN event_type END AS rare FROM {_HOLED}"


@query(
    f"WITH e AS ({_SEEN}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS col, row_number() OVER (ORDER BY event_id) AS rank, {text} AS text, {number} AS number FROM e WHERE {c} IS NOT NULL QUALIFY rank <= 5" for c, text, number in (("event_id", "NULL", "event_id::DOUBLE"), ("value", "NULL", "value"), ("rare", "rare", "NULL")))
)
def first_values(t, spark):
    """What the data dictionary shows of a column: the first values that are there, of a sparse one too."""
    df = _holed(t).select("event_id", "value", F.when(F.col("event_id") % 1500 == 7, F.col("event_type")).alias("rare"))
    found = stats.first_values(df, df.columns)
    rows = [(c, i, v if isinstance(v, str) else None, None if isinstance(v, str) else float(v)) for c, vs in found.items() for i, v in enumerate(vs, 1)]
    return spark.createDataFrame(rows, "col string, rank long, text string, number double")


@query("SELECT o_orderkey, o_orderpriority || chr(10) || '\"' || o_orderstatus || '\", ' || chr(10) || 'x' AS note, o_totalprice AS price FROM orders")
def csv_quoted_breaks(t, spark):
    """Cells with quotes, delimiters and line breaks, written and read back by splits."""
    note = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", \nx'))
    folder = shared_folder(spark, "orders_breaks")
    t("orders").select("o_orderkey", note.alias("note"), F.col("o_totalprice").alias("price")).write.options(header=True, quote='"', escape='"').csv(folder)
    return read_delimited(spark, folder, multiline=True)
