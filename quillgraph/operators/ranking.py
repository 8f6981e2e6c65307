"""Rankings: reciprocal-rank fusion, best rows of groups, even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(channels: DataFrame, key: str = "key", channel: str = "channel", rank: str = "rank") -> DataFrame:
    """key, boost, how: 1000 times the sum over channels of 1 / (60 + best rank), 4 decimals, and those ranks as text."""
    first = channels.groupBy(key, F.col(channel).alias("channel")).agg(F.min(rank).alias("r"))
    ranks = F.transform(F.sort_array(F.collect_list(F.struct("channel", "r"))), lambda c: F.concat(c["channel"], F.lit("#"), c["r"].cast("string")))
    return first.groupBy(key).agg(F.round(1000 * F.sum(1.0 / (RRF_K + F.col("r"))), 4).alias("boost"), F.array_join(ranks, ", ").alias("how"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; partial top-k is pushed below the shuffle by Spark's window group limit."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def even_sample(df: DataFrame, group: str, order: list[Column], n: int = 12) -> DataFrame:
    """At most n rows of each group, at evenly spaced places, the first and last among them."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (n - 1) + 0.5))
    return ranked.where((F.col("__n") <= n) | F.array_contains(places, F.col("__i").cast("bigint"))).drop("__i", "__n")
