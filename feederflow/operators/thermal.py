"""Transformer temperatures: ultimate rises, the step recursion, its scan over time, and the current that a limit allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAMS = ("tau_TO", "tau_W", "delta_theta_TO_R", "delta_theta_HS_R", "R", "n_exp", "m_exp", "I_rated", "theta_HS_max", "dt")


def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Rows with their transformer's parameters, by ``n`` and ``tx_id`` as far as ``params`` has them, exponents n and m renamed.

    Without keys there is one set for all transformers; a second row is an error. The exponent ``n`` is
    the network's key no more once there is an ``n_exp``.
    """
    if "n_exp" not in params.columns:
        params = params.withColumnsRenamed({"n": "n_exp", "m": "m_exp"})
    keys = [c for c in ("n", "tx_id") if c in params.columns and c in df.columns]
    if keys:
        return df.join(params.select(*keys, *PARAMS), keys)
    several = F.raise_error(F.lit("one set of transformer parameters, or sets by tx_id"))
    one = params.agg(F.count(F.lit(1)).alias("_sets"), *[F.first(c).alias(c) for c in PARAMS]).select(*[F.when(F.col("_sets") > 1, several.cast("double")).otherwise(F.col(c)).alias(c) for c in PARAMS])
    return df.join(F.broadcast(one), F.lit(True))  # one row


def load_factor(currents: DataFrame, params: DataFrame) -> DataFrame:
    """(tx_id, t, ..., current_a) with the squared load factor ``k2``."""
    return with_params(currents, params).withColumn("k2", (F.col("current_a") / F.col("I_rated")) ** 2).select(*currents.columns, "k2")


def to_rise(k2: Column) -> Column:
    return F.col("delta_theta_TO_R") * F.pow((k2 * F.col("R") + 1) / (F.col("R") + 1), F.col("n_exp"))


def hs_rise(k2: Column) -> Column:
    return F.col("delta_theta_HS_R") * F.pow(k2, F.col("m_exp"))


def ultimate_rise(k2: DataFrame, params: DataFrame) -> DataFrame:
    return with_params(k2, params).select(*k2.columns, to_rise(F.col("k2")).alias("to_u"), hs_rise(F.col("k2")).alias("hs_u"))


def decay(tau: str) -> Column:
    return F.exp(-F.col("dt") / F.col(tau))


def thermal_step(rise: DataFrame, state: DataFrame, ambient: DataFrame, params: DataFrame) -> DataFrame:
    """One step from the given state (missing: 0)."""
    prev = state.select("tx_id", F.col("delta_theta_TO").alias("_to"), F.col("delta_theta_HS").alias("_hs"))
    j = with_params(rise.join(prev, "tx_id", "left").join(ambient.select("t", "theta_a"), "t"), params)
    step = lambda u, x, tau: (F.col(u) - F.coalesce(x, F.lit(0.0))) * (1 - decay(tau)) + F.coalesce(x, F.lit(0.0))
    j = j.withColumns({"delta_theta_TO": step("to_u", "_to", "tau_TO"), "delta_theta_HS": step("hs_u", "_hs", "tau_W")})
    return j.select("tx_id", "t", "delta_theta_TO", "delta_theta_HS", (F.col("theta_a") + F.col("delta_theta_TO") + F.col("delta_theta_HS")).alias("theta_HS"))


#: Steps of a chunk and chunks of a span of a thermal series.
CHUNK, SPAN = 64, 64


def thermal_series(rise: DataFrame, ambient: DataFrame, params: DataFrame, init: DataFrame | None = None) -> DataFrame:
    """The step chained over time for each transformer; rows with null rises keep the state.

    A step is an affine map x -> a x + b, so the steps of a chunk of time (``CHUNK`` steps of ``dt``) fold to one map, ``SPAN`` chunks
    to another, spans chain by a window, chunks within their span, and each chunk then unfolds from its
    first state. Arrays hold a chunk's steps, a span's chunks, or a transformer's spans, never its whole series, and
    what is copied in a chunk does not grow with the series or the steps of a day.
    """
    r = with_params(rise, params).withColumn("chunk", F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / (60 * CHUNK * F.col("dt"))))
    maps = r.select("tx_id", "t", "chunk", F.when(F.col("to_u").isNull(), 1.0).otherwise(decay("tau_TO")).alias("a1"), F.when(F.col("to_u").isNull(), 0.0).otherwise((1 - decay("tau_TO")) * F.col("to_u")).alias("b1"), F.when(F.col("hs_u").isNull(), 1.0).otherwise(decay("tau_W")).alias("a2"), F.when(F.col("hs_u").isNull(), 0.0).otherwise((1 - decay("tau_W")) * F.col("hs_u")).alias("b2"))
    chunks = maps.groupBy("tx_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "a1", "b1", "a2", "b2"))).alias("steps"))
    one = lambda a1, b1, a2, b2: F.struct(a1.alias("a1"), b1.alias("b1"), a2.alias("a2"), b2.alias("b2"))
    then = lambda m, s: one(s["a1"] * m["a1"], s["a1"] * m["b1"] + s["b1"], s["a2"] * m["a2"], s["a2"] * m["b2"] + s["b2"])
    same = one(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    chunks = chunks.withColumn("whole", F.aggregate("steps", same, then))
    chunks = chunks.withColumn("span", F.floor(F.col("chunk") / SPAN))
    spans = chunks.groupBy("tx_id", "span").agg(F.array_sort(F.collect_list(F.struct("chunk", "whole"))).alias("chunks"))
    spans = spans.select("tx_id", "span", F.aggregate("chunks", same, lambda m, d: then(m, d["whole"])).alias("whole"))
    chained = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("tx_id", "span", F.collect_list("whole").over(chained("tx_id", "span")).alias("earlier"))
    within = chunks.select("*", F.collect_list("whole").over(chained("tx_id", "span", "chunk")).alias("before"))
    chunks = within.join(spans, ["tx_id", "span"]).withColumn("start", F.aggregate("before", F.aggregate("earlier", same, then), then))
    if init is not None:
        chunks = chunks.join(init.select("tx_id", F.col("delta_theta_TO").alias("i1"), F.col("delta_theta_HS").alias("i2")), "tx_id", "left")
    else:
        chunks = chunks.withColumns({"i1": F.lit(0.0), "i2": F.lit(0.0)})
    x1 = F.col("start.a1") * F.coalesce("i1", F.lit(0.0)) + F.col("start.b1")
    x2 = F.col("start.a2") * F.coalesce("i2", F.lit(0.0)) + F.col("start.b2")
    state = lambda t, a, b: F.struct(t.alias("t"), a.alias("x1"), b.alias("x2"))
    seed = F.array(state(F.get("steps", F.lit(0))["t"], x1, x2))
    unfold = F.aggregate("steps", seed, lambda acc, s: F.concat(acc, F.array(state(s["t"], s["a1"] * F.element_at(acc, -1)["x1"] + s["b1"], s["a2"] * F.element_at(acc, -1)["x2"] + s["b2"]))))
    out = chunks.select("tx_id", F.explode(F.slice(unfold, 2, F.size("steps"))).alias("s")).select("tx_id", "s.t", F.col("s.x1").alias("delta_theta_TO"), F.col("s.x2").alias("delta_theta_HS"))
    return out.join(ambient.select("t", "theta_a"), "t").withColumn("theta_HS", F.col("theta_a") + F.col("delta_theta_TO") + F.col("delta_theta_HS")).drop("theta_a")


def hotspot_check(thermal: DataFrame, params: DataFrame) -> DataFrame:
    """(tx_id, peak, hours_over): the highest hot spot and the hours above the limit."""
    j = with_params(thermal, params)
    return j.groupBy("tx_id").agg(F.max("theta_HS").alias("peak"), (F.sum((F.col("theta_HS") > F.col("theta_HS_max")).cast("int")) * F.first("dt") / 60).alias("hours_over"))


def hotspots_over(thermal: DataFrame, params: DataFrame) -> DataFrame:
    """(n if given, tx_id, t, theta_HS, over): the rows above the limit, and by how much."""
    j = with_params(thermal, params).where("theta_HS > theta_HS_max")
    return j.select(*[c for c in ("n",) if c in thermal.columns], "tx_id", "t", "theta_HS", (F.col("theta_HS") - F.col("theta_HS_max")).alias("over"))


def max_current_for_hotspot(state: DataFrame, ambient: DataFrame, params: DataFrame, steps: int = 50) -> DataFrame:
    """(tx_id, t, k2_max, i_max_a): the largest squared load factor that keeps the coming step within the limit.

    The hot spot rises with the load, and by no less than the winding's own step, which bounds the load
    from above; bisections of that range find it; 0 if no load is allowed.
    """
    j = with_params(state.join(ambient.select("t", "theta_a"), "t"), params)
    hot = lambda k2: F.col("theta_a") + (to_rise(k2) - F.col("delta_theta_TO")) * (1 - decay("tau_TO")) + F.col("delta_theta_TO") + (hs_rise(k2) - F.col("delta_theta_HS")) * (1 - decay("tau_W")) + F.col("delta_theta_HS")
    pair = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    left = F.col("theta_HS_max") - F.col("theta_a") - F.col("delta_theta_TO") * decay("tau_TO") - F.col("delta_theta_HS") * decay("tau_W")
    most = F.when(left > 0, F.pow(left / (F.col("delta_theta_HS_R") * (1 - decay("tau_W"))), 1 / F.col("m_exp"))).otherwise(0.0)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(hot(mid) <= F.col("theta_HS_max"), pair(mid, s["hi"])).otherwise(pair(s["lo"], mid))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair(F.lit(0.0), most), halve)
    j = j.withColumn("k2_max", found["lo"])
    return j.select(*[c for c in ("n",) if c in state.columns], "tx_id", "t", "k2_max", (F.sqrt("k2_max") * F.col("I_rated")).alias("i_max_a"))
