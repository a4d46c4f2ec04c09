"""Running sums over groups of any size: sorted within ranges only, whose totals are summed apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.sources.tables import stored


def sums_before(df: DataFrame, by: list[str], part: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each {name: column}, the column's sum over the group's rows before this one (0 for the first).

    ``part`` numbers ranges of the order, so that a later range's rows all come after an earlier's. A task
    sorts one range of a group; the groups' ranges, one row each, are summed by themselves.
    """
    within = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, part).agg(*[F.sum(c).alias(f"_{n}") for n, c in values.items()])
    totals = totals.select(*by, part, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0.0)).alias(f"_{n}") for n in values])
    here = df.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0.0)) for n, c in values.items()})
    joined = here.join(totals, [*by, part])
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop(*[f"_{n}" for n in values])


def dealt_in_order(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows stored with ``_part``, the range of (``by``, ``order``) that they were dealt to; equal rows share one.

    The ranges are those of a sample, so they are written down once and read ever after.
    """
    keys = [*by, *order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return stored(dealt.withColumn("_part", F.spark_partition_id()), "in-order")
