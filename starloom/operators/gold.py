"""The star schema: conformed dimensions, facts, views and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ref, to_double, to_long, type_of
from ..plans.profile import Band, DatasetProfile
from .clean import band, normalise
from .keys import fresh
from .stats import hashes

#: Bits of a Bloom filter for each key, bits that a key sets, and words of 64 bits that a filter has at most (8 MB).
BITS_A_KEY, BITS_OF_A_KEY, MOST_WORDS = 12, 4, 1 << 20

# The rows of the small dimensions.
AGE_BRACKETS = [("0-17", 1, 0.0, 17.999), ("18-39", 2, 18.0, 39.999), ("40-59", 3, 40.0, 59.999), ("60-79", 4, 60.0, 79.999), ("80+", 5, 80.0, None)]
GENDERS = [(0, "Female"), (1, "Male"), (-1, "Unknown")]
FACT_TYPE = {"numeric": "double", "binary": "int", "nominal": "string", "ordinal": "string", "identifier": "long"}
AGE_BANDS = [Band("0-17", 18), Band("18-39", 40), Band("40-59", 60), Band("60-79", 80), Band("80+", float("inf"))]


def dim_age_bracket(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AGE_BRACKETS, "age_bracket string, sort_order int, lower_age double, upper_age double")


def dim_gender(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GENDERS, "gender_id int, gender_code string")


def dim_dataset(spark: SparkSession, profiles: list[DatasetProfile], snapshot_id: int = 1) -> DataFrame:
    rows = [(i, p.name, p.display_name, p.domain, p.description, str(p.profile_path), str(p.source_path), p.fact_table, snapshot_id) for i, p in enumerate(profiles, 1)]
    return spark.createDataFrame(rows, "dataset_id int, dataset_name string, display_name string, domain string, description string, profile_path string, source_path string, fact_table string, snapshot_id int")


def age_bracket(age: Column) -> Column:
    return band(age, AGE_BANDS)


def clamp_gender(c: Column, kind) -> Column:
    """0 or 1, else -1."""
    code = to_long(c, kind)
    return F.when(code.isin(0, 1), code).otherwise(-1).cast("int")


def patient_columns(df: DataFrame, profile: DatasetProfile) -> tuple[Column, Column]:
    """Age (double or null) and gender id of the cleaned rows."""
    age, gender = profile.by_role("age"), profile.by_role("gender")
    years = to_double(ref(age.source), type_of(df, age.source)) if age and age.source in df.columns else F.lit(None).cast("double")
    code = clamp_gender(ref(gender.source), type_of(df, gender.source)) if gender and gender.source in df.columns else F.lit(-1)
    return years, code


def patient_rows(df: DataFrame, profile: DatasetProfile, dataset_id: int) -> DataFrame:
    """The cleaned rows with dataset_id, age and gender_id of the patient (columns with these names give way)."""
    age, gender = patient_columns(df, profile)
    return df.withColumns({"dataset_id": F.lit(dataset_id), "age": age, "gender_id": gender})


def patient_records(df: DataFrame, snapshot_id: int = 1) -> DataFrame:
    """The dimension from (patient_record_id, dataset_id, age, gender_id) of all datasets, whose ids follow one another."""
    first = df.groupBy("dataset_id").agg(F.min("patient_record_id").alias("__first"))  # a row a dataset
    number = F.col("patient_record_id") - F.col("__first") + 1
    return df.join(F.broadcast(first), "dataset_id").select("patient_record_id", F.lit(snapshot_id).alias("snapshot_id"), "dataset_id", number.alias("source_record_num"), "age", "gender_id", age_bracket(F.col("age")).alias("age_bracket"))


def dim_patient_record(df: DataFrame, profile: DatasetProfile, dataset_id: int, first_id: int = 1, snapshot_id: int = 1, number: str = "source_record_num") -> DataFrame:
    """One row a cleaned row, from a frame that has its 1-based ``number``."""
    age, gender = patient_columns(df, profile)
    rows = df.select(ref(number).cast("long").alias("source_record_num"), age.alias("age"), gender.alias("gender_id"))
    return rows.select(
        (F.col("source_record_num") + F.lit(first_id - 1)).alias("patient_record_id"),
        F.lit(snapshot_id).alias("snapshot_id"),
        F.lit(dataset_id).alias("dataset_id"),
        "source_record_num",
        "age",
        "gender_id",
        age_bracket(F.col("age")).alias("age_bracket"),
    )


def fact(df: DataFrame, profile: DatasetProfile, dataset_id: int, first_id: int = 1, snapshot_id: int = 1, number: str = "source_record_num") -> DataFrame:
    """Keys, fact columns in their declared types, bands and the label; a column that the data lack is null."""
    label = profile.target.rename_to
    columns = [(normalise(ref(c.source), type_of(df, c.source), c.type) if c.source in df.columns else F.lit(None).cast(FACT_TYPE[c.type])).alias(c.fact_column) for c in profile.fact_columns()]
    bands = [ref(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in profile.fact_bands()]
    encoded = to_long(ref(label), type_of(df, label)).try_cast("int") if label in df.columns else F.lit(None).cast("int")
    row = ref(number).cast("long")
    return df.select(row.alias("fact_id"), (row + F.lit(first_id - 1)).alias("patient_record_id"), F.lit(snapshot_id).alias("snapshot_id"), F.lit(dataset_id).alias("dataset_id"), *columns, *bands, encoded.alias("label"))


def full_view(facts: DataFrame, patients: DataFrame, genders: DataFrame, datasets: DataFrame, profile: DatasetProfile) -> DataFrame:
    """Facts with their patient, gender and dataset; the small dimensions are broadcast."""
    one = datasets.filter(F.col("dataset_name") == profile.name).select("dataset_id")
    keep = [c for c in facts.columns if c not in ("fact_id", "patient_record_id", "snapshot_id", "dataset_id", "label")]
    joined = facts.select("patient_record_id", *[ref(c) for c in keep], ref("label").alias(f"{profile.name}_label")).join(patients, "patient_record_id")
    joined = joined.join(F.broadcast(genders), "gender_id", "left").join(F.broadcast(one), "dataset_id")
    gender = F.coalesce("gender_code", F.lit("Unknown")).alias("gender")
    return joined.select("patient_record_id", "snapshot_id", "source_record_num", "age", gender, "age_bracket", *[ref(c) for c in keep], f"{profile.name}_label")


def stored_by_key(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Append to a table whose files are bucketed and sorted by a key: joins of such tables on it move no rows.

    Rows are not moved here either: each task sorts what it has and writes a file for each bucket, so
    what a task sorts is what it reads, however large the table is.
    """
    df.write.mode("append").bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)


def summary(facts: dict[str, DataFrame]) -> DataFrame:
    """(dataset, total_records, positive_cases, positive_rate_pct) of each fact table; an empty one has nulls."""

    def one(name: str, df: DataFrame) -> DataFrame:
        positive = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
        rate = F.round(F.lit(100.0) * positive / F.nullif(F.count("*"), F.lit(0)), 2)
        return df.agg(F.count("*").alias("total_records"), positive.alias("positive_cases"), rate.cast("double").alias("positive_rate_pct")).select(F.lit(name).alias("dataset"), "*")

    return reduce(DataFrame.unionAll, [one(n, df) for n, df in facts.items()])


def label_groups(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(ref(label).alias("label")).agg(F.count("*").alias("n"))


def latest_snapshot(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("snapshot_id")).limit(1)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key is there but not in the parent table.

    A Bloom filter of the parent's keys, whose size is bounded, is broadcast.  Rows that it does not
    know are orphans at once and are not moved.  Of the others only the distinct keys are shuffled, to
    be looked for in the parent; the few that the filter took wrongly then find their rows.
    """
    parent_key = parent_key or key
    left, right = type_of(child, key), type_of(parent, parent_key)
    same = None if left == right else "bigint" if all(isinstance(k, T.IntegralType) for k in (left, right)) else "double" if all(isinstance(k, T.NumericType) for k in (left, right)) else "string"
    typed = lambda c: c.cast(same) if same else c
    known = parent.select(typed(ref(parent_key)).alias("k")).filter("k is not null")
    words = min(MOST_WORDS, 1 << max(0, (known.count() * BITS_A_KEY // 64).bit_length()))
    k, word, filled = fresh(child, "k"), fresh(child, "word"), fresh(child, "filled")
    at, mask = _bloom(F.col("k"), words)
    bloom = known.select(at.alias(word), mask.alias("mask")).groupBy(word).agg(F.bit_or("mask").alias(filled))
    at, mask = _bloom(F.col(k), words)
    there = child.filter(ref(key).isNotNull()).withColumn(k, typed(ref(key))).withColumn(word, at)
    told = there.join(F.broadcast(bloom), word, "left").withColumn(filled, F.coalesce(F.col(filled), F.lit(0)).bitwiseAND(mask) == mask)
    columns = [ref(c) for c in child.columns]
    doubtful = told.filter(F.col(filled))
    lost = doubtful.select(k).distinct().join(known.withColumnRenamed("k", k), k, "left_anti")
    return told.filter(~F.col(filled)).select(*columns).unionAll(doubtful.join(lost, k, "left_semi").select(*columns))


def _bloom(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a blocked Bloom filter and the bits in it that a key sets."""
    at, bits = hashes(key)
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * j).bitwiseAND(63).cast("int")) for j in range(BITS_OF_A_KEY)]
    return F.pmod(at, F.lit(words)), reduce(Column.bitwiseOR, one)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def band_rollup(df: DataFrame, *levels: str, label: str = "label") -> DataFrame:
    """Counts and positive cases over every prefix of the levels (an extension: the bands as an OLAP hierarchy)."""
    return df.rollup(*[ref(c) for c in levels]).agg(F.count("*").alias("n"), F.sum(F.when(ref(label) == 1, 1).otherwise(0)).alias("positive"))


