"""Connected components of a table of links, by labels that move along links and through their own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, forget, hot_keys, join_hot


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of the component, for every id in the links (a, b).

    Links of an id and members of a label that are hot are joined where they are.
    """
    both = checkpoint(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    hubs = hot_keys(both, "b")[0]
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"))
    last = None
    while True:
        near = join_hot(both, labels.select(F.col("id").alias("b"), "label"), hubs, "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        stepped = checkpoint(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new")))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))  # every label is an id
        moved = checkpoint(join_hot(stepped, jump, hot_keys(stepped, "new")[0], "new").select("id", "label", F.least("new", "far").alias("new")))
        forget(stepped, *[last] * (last is not None))
        labels, last = moved.select("id", F.col("new").alias("label")), moved
        if not moved.agg(F.count_if(F.col("label") != F.col("new"))).first()[0]:
            forget(both)
            return labels
