"""Distributed cuts through rows ranked by a number.

The place in the ranking at which a running total reaches a budget is found by
histograms: each round counts rows and weights per slice of the key, a group's
few slices are summed in order, and only the slice that holds the cut is divided
again. No row is sorted and no group meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.columns import attach, saved

SLICES = 1024


def _slice(key: Column, low: Column, high: Column) -> Column:
    width = (high - low) / SLICES
    place = F.when(width > 0, F.floor((key - low) / width)).otherwise(0)
    return F.least(F.greatest(place, F.lit(0)), F.lit(SLICES - 1)).cast("int")


def cut_points(rows: DataFrame, group: str, key: str, weight: str, budgets: DataFrame) -> DataFrame:
    """``group, cut, before``: rows of a smaller key fit into the group's budget.

    ``rows`` should be saved, as each round reads it again. ``budgets`` holds
    ``group`` and ``budget``. ``before`` is the weight of all rows whose key lies
    below ``cut``; it is at most the budget, and the rows of the next key would
    pass it. A group whose rows all fit has an infinite cut. Rows of equal key
    stay on the same side.
    """
    bounds = rows.groupBy(group).agg(
        F.min(key).alias("_low"), F.max(key).alias("_high"), F.sum(weight).alias("_sum")
    )
    state = bounds.join(budgets, group).select(
        group,
        "_low",
        "_high",
        F.lit(0.0).alias("_before"),
        F.col("budget").cast("double").alias("_budget"),
        (F.col("_sum") <= F.col("budget")).alias("_fits"),
    )
    order = Window.partitionBy(group).orderBy("_slice")
    state = saved(state)
    while not state.filter("NOT _fits AND _low < _high").isEmpty():
        inside = attach(rows, state.filter("NOT _fits AND _low < _high"), group).filter(
            (F.col(key) >= F.col("_low")) & (F.col(key) <= F.col("_high"))
        )
        part = inside.select(
            group, "_before", "_budget",
            F.col(key).alias("_key"), F.col(weight).cast("double").alias("_weight"),
            _slice(F.col(key), F.col("_low"), F.col("_high")).alias("_slice"),
        ).groupBy(group, "_slice", "_before", "_budget").agg(
            F.sum("_weight").alias("_weight"),
            F.min("_key").alias("_min"),
            F.max("_key").alias("_max"),
        )
        reached = part.withColumn("_upto", F.col("_before") + F.sum("_weight").over(order))
        crossed = (
            reached.filter(F.col("_upto") > F.col("_budget"))
            .groupBy(group)
            .agg(
                F.min_by(F.struct("_min", "_max", (F.col("_upto") - F.col("_weight")).alias("_at")), "_slice").alias("_found")
            )
        )
        narrowed = state.join(crossed, group, "left").select(
            group,
            # Without a crossing, by rounding of the sums, the cut is the highest key.
            F.coalesce("_found._min", "_high").alias("_low"),
            F.coalesce("_found._max", "_high").alias("_high"),
            F.coalesce("_found._at", "_before").alias("_before"),
            "_budget",
            "_fits",
        )
        state = saved(narrowed)
    return state.select(
        group,
        F.when(F.col("_fits"), F.lit(float("inf"))).otherwise(F.col("_low")).alias("cut"),
        F.col("_before").alias("before"),
    )
