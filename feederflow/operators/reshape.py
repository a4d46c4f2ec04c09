"""Meter files from wide to long, series over time, and bids in merit order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.functions.running import dealt_in_order, sums_before
from feederflow.functions.units import INTERVAL_H


def register_filter(wide: DataFrame, suffix: str = "E1") -> DataFrame:
    return wide.where(F.col("NmiSuffix") == suffix)


def wide_to_long(wide: DataFrame) -> DataFrame:
    """(Nmi, IntervalDay, interval, energy) without nulls."""
    values = [c for c in wide.columns if c.startswith("Data_")]
    return wide.unpivot(["Nmi", "IntervalDay"], values, "interval", "energy").where("energy is not null")


def interval_timestamp(long: DataFrame) -> DataFrame:
    """``t`` from the day and a column name like Data_07_30."""
    clock = F.replace(F.replace("interval", F.lit("Data_"), F.lit("")), F.lit("_"), F.lit(":"))
    return long.withColumn("t", F.to_timestamp(F.concat_ws(" ", F.col("IntervalDay").cast("string"), clock), "yyyy-MM-dd HH:mm").cast("timestamp_ntz"))


def to_power(long: DataFrame, factor: float = 1000.0, q_ratio: float = 0.4) -> DataFrame:
    """Whole watts and vars, ties to even."""
    p = F.bround(F.col("energy") * factor, 0)
    return long.select("t", F.col("Nmi").alias("load_id"), p.cast("long").alias("real_power_w"), F.bround(F.col("energy") * factor * q_ratio, 0).cast("long").alias("reactive_power_var"))


def sorted_export(readings: DataFrame) -> DataFrame:
    return readings.orderBy("t", "load_id")


def drop_missing(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The series without null totals, and how many there were."""
    return series.dropna(subset=["total_kw"]), series.agg(F.sum(F.col("total_kw").isNull().cast("int")).alias("dropped"))


def split_net_load(series: DataFrame) -> DataFrame:
    return series.select("t", F.greatest(F.col("total_kw"), F.lit(0.0)).alias("base_kw"), F.greatest(-F.col("total_kw"), F.lit(0.0)).alias("solar_kw"))


def smooth_centered(df: DataFrame, key: str, t: str, value: str, width: int = 4) -> DataFrame:
    """A centred mean of ``width`` rows, of fewer at the ends."""
    w = Window.partitionBy(key).orderBy(t).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn("smoothed", F.avg(value).over(w))


def share_of_total(df: DataFrame, t: str, value: str, total: str) -> DataFrame:
    """Values scaled to sum to the total of their time; 0 where the total is not positive."""
    sums = df.groupBy(t).agg(F.sum(value).alias("_sum"))
    return df.join(sums, t).withColumn("share", F.when(F.col(total) > 0, F.col(value) / F.col("_sum") * F.col(total)).otherwise(0.0)).drop("_sum")


def resample_interpolate(ambient: DataFrame, minutes: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hourly series, one of each key (such as a station), on a finer grid, linear between their points."""
    w = Window.partitionBy(*keys).orderBy("t")  # of the ambient series alone, not of the readings
    a = ambient.select(*keys, "t", "theta_a", F.lead("t").over(w).alias("t2"), F.lead("theta_a").over(w).alias("th2"))
    step = F.expr(f"interval {minutes} minutes")
    grid = a.withColumn("g", F.explode(F.when(F.col("t2").isNull(), F.array("t")).otherwise(F.sequence("t", F.col("t2") - step, step))))
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return grid.select(*keys, F.col("g").alias("t"), F.when(F.col("t2").isNull(), F.col("theta_a")).otherwise(F.col("theta_a") + (F.col("th2") - F.col("theta_a")) * (sec("g") - sec("t")) / (sec("t2") - sec("t"))).alias("theta_a"))


def step_number(readings: DataFrame, key: str = "n") -> DataFrame:
    """Order of the distinct times of each network; the times alone are ranked, then joined."""
    steps = readings.select(key, "t").distinct().withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy("t")))
    return readings.join(steps, [key, "t"])


def interval_check(readings: DataFrame, dt_min: float) -> DataFrame:
    """(n if given, load_id, t, gap_min, kind): readings whose distance from the load's one before is not ``dt_min``."""
    keys = [c for c in ("n", "load_id") if c in readings.columns]
    w = Window.partitionBy(*keys).orderBy("t")
    sec = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    gap = (sec(F.col("t")) - sec(F.lag("t").over(w))) / 60.0
    out = readings.select(*keys, "t", gap.alias("gap_min"))
    kind = F.when(F.col("gap_min") == 0, "duplicate").when(F.col("gap_min") > dt_min, "gap").otherwise("short")
    return out.where(F.col("gap_min").isNotNull() & (F.col("gap_min") != dt_min)).withColumn("kind", kind)


def merit_order(tiers: DataFrame, required: DataFrame, keys: tuple[str, ...] = ("n",)) -> DataFrame:
    """Tiers (keys, load_id, tier, kw, price) taken by price until the required kW are met: ``taken_kw``, ``cost_dlr``.

    A key's tiers may fill several tasks: they are dealt out in their order.
    """
    order = ["price", "load_id", "tier"]
    dealt = sums_before(dealt_in_order(tiers, list(keys), order), list(keys), "_part", order, {"_before": "kw"})
    j = dealt.join(required, list(keys))
    taken = F.greatest(F.lit(0.0), F.least(F.col("kw"), F.col("required_kw") - F.col("_before")))
    return j.select(*keys, "load_id", "tier", taken.alias("taken_kw"), (taken * F.col("price") * INTERVAL_H).alias("cost_dlr")).where("taken_kw > 0")


def tiers_of(offers: DataFrame, column: str) -> DataFrame:
    """(n and t if given, load_id, tier, kw, price) of the bids of one direction."""
    keys = [c for c in ("n", "t", "load_id") if c in offers.columns]
    return offers.select(*keys, F.posexplode(column).alias("tier", "pair")).select(*keys, "tier", F.get("pair", F.lit(0)).alias("kw"), F.get("pair", F.lit(1)).alias("price"))


def series_stats(series: DataFrame) -> DataFrame:
    x = F.col("total_kw")
    return series.agg(F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min(x).alias("kw_min"), F.max(x).alias("kw_max"), F.avg(x).alias("kw_mean"), F.avg((x < 0).cast("double")).alias("neg_share"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
