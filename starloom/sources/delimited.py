"""Delimited files: all columns are read as text, missing-value tokens become null, then types are inferred."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import INTEGER, NUMBER, ref, strip, to_double
from .quoted import read_quoted

# The missing-value tokens that tabular readers take by default.
DEFAULT_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DELIMITERS = ",;\t|"


def na_to_null(c: Column, tokens: Iterable[str]) -> Column:
    """Null where the whole cell is a token; white space counts."""
    return F.when(c.isin(*tokens), None).otherwise(c)


def replace_tokens(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    tokens = list(tokens)
    return df.select(*[(na_to_null(ref(f.name), tokens) if isinstance(f.dataType, T.StringType) else ref(f.name)).alias(f.name) for f in df.schema.fields])


def type_counts(df: DataFrame) -> DataFrame:
    """One row: for each text column i how many cells are there (n), whole numbers (w), numbers (d) and truth values (b)."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = ref(f.name)
        if isinstance(f.dataType, T.StringType):
            number = F.count_if(c.rlike(NUMBER) | F.coalesce(to_double(c, f.dataType).isin(float("inf"), float("-inf")), F.lit(False)))
            aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.rlike(INTEGER) & F.trim(c).try_cast("long").isNotNull()).alias(f"w{i}"), number.alias(f"d{i}"), F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}")]
    return df.agg(F.count("*").alias("rows"), *aggs)


def infer_types(df: DataFrame) -> dict[str, str]:
    """long, double, boolean or string for each text column.

    Whole numbers with gaps are doubles, as in tabular readers: their text then is ``1.0``.  A
    column without any cell is a double.
    """
    got = type_counts(df).first().asDict()
    kinds = {}
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.StringType):
            n, whole, number, truth = (got[f"{k}{i}"] for k in "nwdb")
            kinds[f.name] = "long" if n and whole == n == got["rows"] else "double" if number == n else "boolean" if truth == n == got["rows"] else "string"
    return kinds


def apply_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    def cast(f: T.StructField) -> Column:
        c, kind = ref(f.name), kinds.get(f.name, "string")
        if kind == "double":
            return to_double(c, f.dataType)
        return c if kind == "string" else F.trim(c).try_cast(kind)

    return df.select(*[cast(f).alias(f.name) for f in df.schema.fields])


def read_text_columns(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool = False) -> DataFrame:
    """Every column as text, in the order of the header.  With ``multiline`` quoted cells may hold line breaks; files are split all the same."""
    plain, whole = (spark.read.options(header=True, sep=delimiter, quote='"', escape='"', multiLine=m, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) for m in (False, True))
    return read_quoted(spark, path, delimiter, plain.csv(path), whole.csv(path)) if multiline else plain.csv(path)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", na_values: Iterable[str] = (), multiline: bool = False) -> DataFrame:
    """A typed frame of a file with a header.  One pass over the file infers the types."""
    df = replace_tokens(read_text_columns(spark, path, delimiter, multiline), [*DEFAULT_TOKENS, *na_values])
    return apply_types(df, infer_types(df))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def strip_strings(df: DataFrame) -> DataFrame:
    return df.select(*[(strip(ref(f.name)) if isinstance(f.dataType, T.StringType) else ref(f.name)).alias(f.name) for f in df.schema.fields])


def sniff_delimiter(spark: SparkSession, path: str) -> tuple[str, str]:
    """(delimiter, confidence) from the file's first lines, some 8,000 characters."""
    sample, size = [], 0
    for row in spark.read.text(path).limit(200).collect():
        sample.append(row[0])
        size += len(row[0]) + 1
        if size > 8192:
            break
    text = "\n".join(sample)[:8192]
    try:
        return csv.Sniffer().sniff(text, delimiters=DELIMITERS).delimiter, "HIGH"
    except csv.Error:
        first = sample[0] if sample else ""
        return max(DELIMITERS, key=first.count), "MEDIUM"


