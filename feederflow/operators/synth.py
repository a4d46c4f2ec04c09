"""Synthetic customers whose profiles sum to a transformer's series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feederflow.operators.reshape import split_net_load

# fixed values: a linear congruential generator on 31 bits, and three of its steps in one (products of 31 bits fit a long)
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 1 << 31
LCG_A3, LCG_C3 = LCG_A**3 % LCG_M, LCG_C * (LCG_A**2 + LCG_A + 1) % LCG_M


def customer_roster(spark: SparkSession, n: int, solar_share: float, bus_split: dict[str, float]) -> DataFrame:
    """(idx, load_id, bus_id, is_solar): each bus takes its rounded fraction, the last one the rest."""
    if abs(sum(bus_split.values()) - 1) > 1e-9:
        raise ValueError("bus fractions must sum to 1")
    edges, at = [], 0
    for k, (bus, share) in enumerate(bus_split.items()):
        at = n if k == len(bus_split) - 1 else min(n, at + round(n * share))
        edges.append((bus, at))
    bus = F.lit(edges[-1][0])
    for name, end in reversed(edges[:-1]):
        bus = F.when(F.col("idx") < end, name).otherwise(bus)
    return spark.range(n).select(F.col("id").alias("idx"), F.format_string("NMI_%03d", F.col("id") + 1).alias("load_id")).withColumns({"bus_id": bus, "is_solar": F.col("idx") < round(n * solar_share)})


def _uniform(x: Column, seed: int) -> Column:
    """A number in (0, 1) from an integer key: three steps of the generator, whose modulus is a power of two."""
    s = F.lit(LCG_M - 1).bitwiseAND((x + seed).bitwiseAND(F.lit(LCG_M - 1)) * LCG_A3 + LCG_C3)
    return (s + 0.5) / LCG_M


def _normal(x: Column, seed: int) -> Column:
    """Box-Muller on two uniforms of the key."""
    return F.sqrt(-2 * F.log(_uniform(x, seed))) * F.cos(2 * math.pi * _uniform(x, seed + 7919))


def customer_times(roster: DataFrame, times: DataFrame, parts: int = 128) -> DataFrame:
    """Every customer at every row of ``times``, which is what is asked for: customers are dealt to ``parts`` parts, and each part has all times.

    A customer is in one part alone; the times, of which a series has far fewer rows, are what is repeated.
    """
    dealt = roster.withColumn("_part", F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int")).repartition(parts, "_part")
    return dealt.join(times.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "_part").drop("_part")


def _minute(t: Column) -> Column:
    return F.floor(F.unix_seconds(t.cast("timestamp")) / 60)


def _noise(sigma: float, seed: int, minute: Column) -> Column:
    return 1 + sigma * _normal(F.col("idx") * 65537 + minute * 31, seed + 1)


def _size(sigma: float, seed: int) -> Column:
    return F.exp(sigma * _normal(F.col("idx") * 1009, seed))


def customer_weights(roster: DataFrame, times: DataFrame, size_sigma: float, noise_sigma: float, seed: int, parts: int = 128) -> DataFrame:
    """(idx, load_id, t, noise, weight): log-normal size times normal noise, both functions of keys alone."""
    sized = roster.withColumn("_size", _size(size_sigma, seed))
    noise = _noise(noise_sigma, seed, _minute(F.col("t")))
    return customer_times(sized, times.select("t").distinct(), parts).withColumn("noise", noise).withColumn("weight", F.col("_size") * F.col("noise")).drop("_size")


#: Rows before and after a time whose weights are averaged with its own.
AROUND = (-2, -1, 0, 1)


def _times_around(times: DataFrame) -> DataFrame:
    """The distinct times with the minutes of those around them, ``_m0`` to ``_m3`` (null beyond the ends): one row a time, as a series has."""
    w = Window.orderBy("t")
    shifted = [(F.lag("t", -k).over(w) if k else F.col("t")) for k in AROUND]
    return times.select("t").distinct().select("t", *[_minute(c).alias(f"_m{j}") for j, c in enumerate(shifted)])


def _smoothed(noise_sigma: float, seed: int):
    """(size, idx, minutes around a time) to a customer's mean weight over these times, at least 1e-6: weights follow from keys, so no row meets another."""
    def draw(x: np.ndarray, seed: int) -> np.ndarray:
        return ((((x + seed) & (LCG_M - 1)) * LCG_A3 + LCG_C3 & (LCG_M - 1)) + 0.5) / LCG_M

    def mean(size: pd.Series, idx: pd.Series, *minutes: pd.Series) -> pd.Series:
        out, own = np.full(len(size), np.nan), size.notna().to_numpy()
        s, i = size.to_numpy(float)[own], idx.to_numpy()[own]
        total, count = np.zeros(len(s)), np.zeros(len(s))
        for m in minutes:
            known = m.notna().to_numpy()[own]
            x = i * 65537 + m.fillna(0).to_numpy().astype(np.int64)[own] * 31
            normal = np.sqrt(-2 * np.log(draw(x, seed + 1))) * np.cos(2 * math.pi * draw(x, seed + 1 + 7919))
            total += np.where(known, s * (1 + noise_sigma * normal), 0.0)
            count += known
        out[own] = np.maximum(total / count, 1e-6)
        return pd.Series(out)

    return F.pandas_udf(mean, "double")


def _shares(roster: DataFrame, totals: DataFrame, kinds: dict[str, tuple[int, Column]], size_sigma: float, noise_sigma: float, parts: int = 128) -> DataFrame:
    """Every customer at every time of ``totals`` (t, {kind}_kw) with its share of each kind's total, 0 where that is not positive.

    ``kinds`` are {name: (seed, who takes part)}. The weights are made twice, once for each time's sums and once for the
    shares, so that the product of customers and times is neither shuffled nor sorted.
    """
    sized = roster.withColumns({f"_size_{k}": F.when(who, _size(size_sigma, seed)) for k, (seed, who) in kinds.items()})
    weights = {k: _smoothed(noise_sigma, seed)(f"_size_{k}", "idx", *[f"_m{j}" for j in range(len(AROUND))]) for k, (seed, _) in kinds.items()}
    times = _times_around(totals)
    sums = customer_times(sized, times, parts).groupBy("t").agg(*[F.sum(w).alias(f"_sum_{k}") for k, w in weights.items()])
    each = customer_times(sized, times.join(sums, "t").join(totals, "t"), parts)
    share = lambda k: F.coalesce(F.when(F.col(f"{k}_kw") > 0, weights[k] / F.col(f"_sum_{k}") * F.col(f"{k}_kw")), F.lit(0.0))
    return each.select("idx", "load_id", "t", *[share(k).alias(k) for k in kinds])


def make_profiles(roster: DataFrame, totals: DataFrame, size_sigma: float, noise_sigma: float, seed: int) -> DataFrame:
    """(idx, load_id, t, kw): smoothed positive weights, scaled to each time's total (t, total_kw)."""
    return _shares(roster, totals.select("t", F.col("total_kw").alias("kw_kw")), {"kw": (seed, F.lit(True))}, size_sigma, noise_sigma)


def disaggregate(series: DataFrame, roster: DataFrame, size_sigma: float = 0.4, noise_sigma: float = 0.15, seed: int = 42) -> DataFrame:
    """(load_id, t, net_kw): base load over all customers less solar over the solar ones, both profiles made together."""
    kinds = {"base": (seed, F.lit(True)), "solar": (seed + 100, F.col("is_solar"))}
    each = _shares(roster, split_net_load(series), kinds, size_sigma, noise_sigma)
    return each.select("load_id", "t", (F.col("base") - F.col("solar")).alias("net_kw"))


def sum_check(profiles: DataFrame, series: DataFrame, most: float = 1e-6) -> DataFrame:
    """(max_abs_err, ok): customers' sums against the totals."""
    sums = profiles.groupBy("t").agg(F.sum("net_kw").alias("_s"))
    err = series.join(sums, "t").agg(F.max(F.abs(F.col("_s") - F.col("total_kw"))).alias("max_abs_err"))
    return err.withColumn("ok", F.col("max_abs_err") <= most)


def reactive_from_pf(profiles: DataFrame, pf: float) -> DataFrame:
    p = F.col("net_kw") * 1000
    return profiles.select("t", "load_id", F.round(p, 2).alias("real_power_w"), F.round(p * F.tan(F.acos(F.lit(pf))), 2).alias("reactive_power_var"))


def customer_rows(profiles: DataFrame, roster: DataFrame) -> DataFrame:
    """(load_id, bus_id, is_solar, mean_kw, min_kw, max_kw, export_share) of each customer."""
    x = F.col("net_kw")
    per = profiles.groupBy("load_id").agg(F.avg(x).alias("mean_kw"), F.min(x).alias("min_kw"), F.max(x).alias("max_kw"), F.avg((x < 0).cast("double")).alias("export_share"))
    return roster.select("load_id", "bus_id", "is_solar").join(per, "load_id")


def customer_summary(profiles: DataFrame, roster: DataFrame) -> DataFrame:
    """(bus_id, customers, mean_kw, min_mean_kw, max_mean_kw, export_share): over customers' means, by bus, and of all with a null bus."""
    per = customer_rows(profiles, roster)
    m = F.col("mean_kw")
    out = per.rollup("bus_id").agg(F.count(F.lit(1)).alias("customers"), F.avg(m).alias("mean_kw"), F.min(m).alias("min_mean_kw"), F.max(m).alias("max_mean_kw"), F.avg("export_share").alias("export_share"))
    return out.where("customers > 0")
