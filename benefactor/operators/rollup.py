"""Parent roll-up at three levels: counts, counts with children kept, and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefactor.operators.aliases import AliasDictionary


def parent_map(dictionary: AliasDictionary) -> Column:
    pairs = [F.lit(x) for pair in dictionary.parent.items() for x in pair]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def roll_counts(counts: DataFrame, dictionary: AliasDictionary, keys: tuple[str, ...] = (), values: tuple[str, ...] = ("n",)) -> DataFrame:
    """Children's counts go to their parents, for parents that have counts; other children stay.

    Sums, so an article that names child and parent counts twice for the parent. `counts` has a
    row for each funder (and keys), about a hundred funders.
    """
    parent = parent_map(dictionary)[F.col("funder")]
    present = counts.select(F.col("funder").alias("__parent")).distinct()
    met = counts.withColumn("__up", parent).join(F.broadcast(present), F.col("__up") == F.col("__parent"), "left")
    target = F.coalesce("__parent", "funder").alias("funder")
    return met.groupBy(target, *keys).agg(*[F.sum(v).alias(v) for v in values])


def roll_generic(counts: DataFrame, dictionary: AliasDictionary, include_children: bool = False) -> DataFrame:
    """funder, n: parents are made where they lack; children stay only if asked for."""
    parent = parent_map(dictionary)[F.col("funder")]
    up = counts.select(parent.alias("funder"), "n").where("funder is not null")
    own = counts.select("funder", "n")
    if not include_children:
        own = own.where(parent.isNull())
        up = up.where(parent_map(dictionary)[F.col("funder")].isNull())
    return own.union(up).groupBy("funder").agg(F.sum("n").alias("n"))


def roll_lists(funders: Column, dictionary: AliasDictionary) -> Column:
    """Each child in an article's list becomes its parent, once; sorted."""
    parent = parent_map(dictionary)
    return F.array_sort(F.array_distinct(F.transform(funders, lambda f: F.coalesce(parent[f], f))))
