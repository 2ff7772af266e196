"""Connected components of links, by smallest labels and pointer jumping over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import store


def components(links: DataFrame) -> DataFrame:
    """(key, label) for every key in ``links`` (a, b): the smallest key of its component.

    A round gives each key the smallest label among its neighbours, then the label of its
    label. Rounds grow with the logarithm of a component's length; each is written to the
    shared folder. Nothing is gathered; a hub's links are joined row by row. Null keys have
    no component; no links give no rows.
    """
    both = store(links.select("a", "b").union(links.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    labels = store(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.key).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.key == near.a).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
        after = lower.join(jump, "label").select("key", "old", F.least("label", "next").alias("label"))
        after = store(after, "labels")
        if after.where("label < old").isEmpty():
            return after.select("key", "label")
        labels = after.select("key", "label")
