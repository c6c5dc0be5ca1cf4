"""Global order without a single task: positions and running totals in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators.storage import stored


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt by ranges of ``order``; ``part`` numbers the ranges in that order. Stored."""
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")


def running_totals(df: DataFrame, values: dict[str, Column], order: list[Column]) -> DataFrame:
    """Adds, under each name, the total of its value over all rows up to and with this one in ``order``.

    Ranges are summed apart; only one row of sums per range is brought in order.
    """
    r = ranged(df, *order)
    sums = r.groupBy("part").agg(*[F.sum(v).alias(f"_own_{n}") for n, v in values.items()])
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = sums.select("part", *[F.coalesce(F.sum(f"_own_{n}").over(first), F.lit(0)).alias(f"_before_{n}") for n in values])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(F.broadcast(before), "part").withColumns({n: F.col(f"_before_{n}") + F.sum(v).over(within) for n, v in values.items()})
    return out.drop("part", *[f"_before_{n}" for n in values])


def running_total(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """:func:`running_totals` of one value."""
    return running_totals(df, {name: value}, order)
