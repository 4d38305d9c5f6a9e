"""Exact nearest-rank percentiles per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.operators.positions import sliced


def nearest_rank(percent: float, count: Column) -> Column:
    """Place, from 1, of a percentile among ``count`` sorted values."""
    return F.greatest(F.ceil(F.lit(percent / 100) * count), F.lit(1)).cast("bigint")


def exact_percentiles(
    samples: DataFrame, value: str, percents: Mapping[str, float], by: Sequence[str]
) -> DataFrame:
    """One column per percentile for every group of the non-null ``by`` columns.

    The built-in exact percentile keeps all distinct values of a group in one
    task. Here equal values are counted first, which also spreads a hot group
    over all tasks. The counts are laid out in slices, ranges of group and value;
    counts per slice say which slice holds a wanted rank, and only rows of such
    a slice are added up. Slices are as small as shuffle partitions, however
    large a group is and whatever its values are.
    """
    by = list(by)
    counted = (
        samples.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    laid = sliced(counted, *[F.asc(name) for name in (*by, "value")]).drop("place")
    group = Window.partitionBy(*by)
    upto = F.sum("size").over(group.orderBy("slice"))
    sizes = (
        laid.groupBy(*by, "slice").agg(F.sum("n").alias("size"))
        .withColumns({"upto": upto, "total": F.sum("size").over(group)})
    )
    ranks = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), nearest_rank(percent, F.col("total")).alias("rank"))
        for name, percent in percents.items()
    ]))
    before = F.col("upto") - F.col("size")
    wanted = (
        sizes.select(*by, "slice", "size", "upto", ranks.alias("r"))
        .filter((F.col("r.rank") > before) & (F.col("r.rank") <= F.col("upto")))
        .select(*by, "slice", F.col("r.name").alias("name"), (F.col("r.rank") - before).alias("rank"))
    )
    running = F.sum("n").over(Window.partitionBy(*by, "slice", "name").orderBy("value"))
    held = laid.join(wanted, [*by, "slice"]).withColumn("running", running)
    found = held.filter(
        (F.col("rank") > F.col("running") - F.col("n")) & (F.col("rank") <= F.col("running"))
    )
    return found.groupBy(*by).agg(*[
        F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in percents
    ])
