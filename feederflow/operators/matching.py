"""Joins of readings, offers and prices with the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.functions.keys import shared_keys
from feederflow.functions.units import pu_of_kw, pu_of_w

SIDES, DIRECTIONS = ("oel", "oer"), ("con", "inj")


def match_forecasts(readings: DataFrame, load: DataFrame) -> DataFrame:
    return of_loads(readings, load)


def match_offers(offers: DataFrame, load: DataFrame) -> DataFrame:
    return of_loads(offers, load)


def of_loads(table: DataFrame, load: DataFrame) -> DataFrame:
    on = shared_keys(table, load)
    return table.join(load.select(*on), on, "left_semi")


def unmatched_ids(readings: DataFrame, offers: DataFrame, load: DataFrame) -> DataFrame:
    """Ids on one side only: (source, load_id), with their network where both sides name it."""
    on, bids = shared_keys(readings, load), shared_keys(offers, load)
    ids = lambda df, source, keys: df.select(*keys).distinct().select(F.lit(source).alias("source"), *keys)
    out = ids(readings.join(load.select(*on), on, "left_anti"), "forecast", on)
    out = out.unionByName(ids(offers.join(load.select(*bids), bids, "left_anti"), "offer", bids), allowMissingColumns=True)
    return out.unionByName(ids(load.join(readings.select(*on), on, "left_anti"), "network", on), allowMissingColumns=True)


def participants(load: DataFrame, readings: DataFrame, ids: DataFrame | None = None, mode: str = "doe") -> DataFrame:
    """Shared envelopes: loads with offers (``ids``). Dynamic ones: all forecast loads, or those of ``ids`` that are forecast."""
    out = load.select("n", "load_id")
    if mode == "doe":
        out = of_loads(out, readings)
    return out if ids is None else of_loads(out, ids)


def prices_default_zero(people: DataFrame, prices: DataFrame) -> DataFrame:
    on = shared_keys(people, prices)
    return people.join(prices.select(*on, "export_price_kwh"), on, "left").select("n", "load_id", F.coalesce("export_price_kwh", F.lit(0.0)).alias("export_price_kwh"))


def index_product(df: DataFrame, directions: bool = False) -> DataFrame:
    """Every row for each side (and direction): an explode of two or four constants."""
    out = df.withColumn("oe", F.explode(F.array(*map(F.lit, SIDES))))
    return out.withColumn("ci", F.explode(F.array(*map(F.lit, DIRECTIONS)))) if directions else out


def known_around(times: DataFrame, series: DataFrame, keys: tuple[str, ...] = (), bucket: str = "hour") -> DataFrame:
    """Distinct times (``keys``, t) with the points of their key's series (``keys``, t, theta_a) around them.

    ``before`` is the last point at or before the time, ``after`` the first one behind it, structs (t, theta_a) or null. Both sides
    are sorted within a key's ``bucket`` of time only; buckets, one row each, hand their last and first points to the others.
    """
    by = [*keys, "_bucket"]
    point = F.when(F.col("_known"), F.struct("t", "theta_a"))
    rows = times.select(*keys, "t").distinct().withColumns({"theta_a": F.lit(None).cast("double"), "_known": F.lit(False)})
    rows = rows.unionByName(series.select(*keys, "t", "theta_a").withColumn("_known", F.lit(True)))
    rows = rows.withColumns({"_bucket": F.date_trunc(bucket, F.col("t")), "_point": point})
    edges = rows.groupBy(*by).agg(F.min("_point").alias("_first"), F.max("_point").alias("_last"))
    # what follows is what came before in the reverse order: a frame that grows is read once, one that shrinks anew for each row
    order, back = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_bucket", F.desc("_bucket")))
    edges = edges.select(*by, F.last("_last", True).over(order).alias("_earlier"), F.last("_first", True).over(back).alias("_later"))
    # a point at the very time counts as before it
    here = Window.partitionBy(*by).orderBy("t", F.desc("_known")).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*by).orderBy(F.desc("t"), "_known").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select("*", F.last("_point", True).over(here).alias("before"), F.last("_point", True).over(back).alias("after"))
    joined = near.where("not _known").join(edges, by)
    return joined.select(*keys, "t", F.coalesce("before", "_earlier").alias("before"), F.coalesce("after", "_later").alias("after"))


def ambient_at(times: DataFrame, ambient: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, theta_a, extrapolated): temperatures read linearly between points, flat outside them.

    ``keys`` name the series that a time reads, such as a network or a station; a key without a series has no rows.
    Points of one key at one time are averaged.
    """
    points = ambient.groupBy(*keys, "t").agg(F.avg("theta_a").alias("theta_a"))
    near = known_around(times, points, keys).where("before is not null or after is not null")
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a, b = F.col("before.theta_a"), F.col("after.theta_a")
    line = a + (b - a) * (sec("t") - sec("before.t")) / (sec("after.t") - sec("before.t"))
    theta = F.when(F.col("before").isNull(), b).when(F.col("after").isNull() | (F.col("before.t") == F.col("t")), a).otherwise(line)
    outside = F.col("before").isNull() | (F.col("after").isNull() & (F.col("before.t") < F.col("t")))
    return near.select(*keys, "t", theta.alias("theta_a"), outside.alias("extrapolated"))


def nodal_allocation(load: DataFrame, readings: DataFrame, envelope: DataFrame | None) -> DataFrame:
    """(n, t, oe, bus_id, p_pu, q_pu): the envelope (n, t, load_id, oe, kw, injection positive) of those who
    have one, negated; the forecast of the others; reactive power always as forecast."""
    r = index_product(load.select("n", "load_id", "bus_id").join(readings, shared_keys(load, readings)))
    p = pu_of_w(F.col("real_power_w"))
    if envelope is not None:
        r = r.join(envelope.select("n", "t", "load_id", "oe", "kw"), ["n", "t", "load_id", "oe"], "left")
        p = F.coalesce(-pu_of_kw(F.col("kw")), p)
    return r.groupBy("n", "t", "oe", "bus_id").agg(F.sum(p).alias("p_pu"), F.sum(pu_of_w(F.col("reactive_power_var"))).alias("q_pu"))


def bus_background_load(bus: DataFrame, load: DataFrame, readings: DataFrame, people: DataFrame, mode: str = "soe") -> DataFrame:
    """(n, t, bus_id, p_kw, q_kw): active power of non-participants and reactive power of all, at each time that the network has readings.

    Buses without loads have 0. Readings without ``t`` are one snapshot, and the result has no ``t``; then networks without readings are there too.
    """
    keys = ["n", *(c for c in ("t",) if c in readings.columns)]
    r = load.select("n", "load_id", "bus_id").join(readings, shared_keys(load, readings)).join(people.select("n", "load_id", F.lit(True).alias("_in")), ["n", "load_id"], "left")
    p = F.when(F.col("_in").isNull(), F.col("real_power_w")).otherwise(0.0) if mode == "soe" else F.lit(0.0)
    by_bus = r.groupBy(*keys, "bus_id").agg((F.sum(p) / 1e3).alias("p_kw"), (F.sum("reactive_power_var") / 1e3).alias("q_kw"))
    every = bus.select("n", "bus_id")
    every = every.join(by_bus.select(*keys).distinct(), "n") if len(keys) > 1 else every
    return every.join(by_bus, [*keys, "bus_id"], "left").select(*keys, "bus_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p_kw", "q_kw")])


def scale_loads(readings: DataFrame, factors: list[float]) -> DataFrame:
    out = readings.withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    return out.withColumns({c: F.col(c) * F.col("factor") for c in ("real_power_w", "reactive_power_var")})


def snapshot_at(readings: DataFrame, t) -> DataFrame:
    return readings.where(F.col("t") == F.lit(t)).select("load_id", "real_power_w", "reactive_power_var")
