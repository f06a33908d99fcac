"""Connected components of a links table, by hooking and pointer jumping on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label), links (a, b) between nodes of ``labels``: the labels after merging along the links.

    A label is the smallest node of its component. Each round maps the links to labels, hooks every label on its
    smallest neighbour and halves the chains until none is left; the rounds are logarithmic in the longest chain.
    Labels and links are tables, so hot keys meet in joins of two exchanges, which Spark splits.
    """
    first, open_ = labels, materialize(links.select("a", "b").distinct(), "links")
    while True:
        la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = open_.join(la, "a").join(lb, "b").where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct()
        between = materialize(between, "links")
        release(open_)
        if between.isEmpty():
            release(between)
            return labels
        parents = materialize(between.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("parent")), "parents")
        while True:
            up = parents.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            jumped = materialize(parents.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
            release(parents)
            parents = jumped
            if jumped.where("moved").isEmpty():
                break
        renamed = parents.select(F.col("child").alias("label"), "parent")
        merged = materialize(labels.join(renamed, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        release(parents, *([labels] if labels is not first else []))
        labels = merged
        # links are now between labels, which are nodes themselves
        open_ = between
