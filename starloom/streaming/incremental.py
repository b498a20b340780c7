"""Incremental loads (an extension): a stream of raw rows goes through a profile's row-level operators into its fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..functions.values import ref
from ..operators import clean as ops
from ..plans.clean import labelled, row_level
from ..plans.profile import DatasetProfile
from ..sources.delimited import strip_strings


def clean_stream(rows: DataFrame, profile: DatasetProfile) -> DataFrame:
    """The operators that need no look at other rows; rows whose label is null are left out, medians are not known to a stream."""
    if bad := [c.source for c in profile.columns if c.imputation and c.imputation.get("strategy") != "constant"]:
        raise ValueError(f"a stream cannot impute medians: {bad}")
    df = strip_strings(rows) if profile.cleaning.strip_whitespace else rows

    def fill(df: DataFrame) -> DataFrame:
        for spec in profile.columns:
            if spec.imputation and spec.source in df.columns:
                df = ops.impute_constant(df, spec.source, spec.imputation.get("value"))
        return df

    return labelled(row_level(df, profile, fill=fill), profile.target).filter(ref(profile.target.rename_to).isNotNull())


def append_stream(rows: DataFrame, profile: DatasetProfile, path: str, checkpoint: str) -> DataStreamWriter:
    """Append cleaned rows to a Parquet table; the checkpoint makes each row count once."""
    return clean_stream(rows, profile).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
