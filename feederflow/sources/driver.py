"""The driver's tables as engine tables: networks from regions, nations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feederflow.sources.tables import BODY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, nation, cust, k, nn, bal, parent_k): a ternary tree of customers in each nation."""
    w = Window.partitionBy("c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("int").alias("n"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.select("n", F.col("c_nationkey").cast("int").alias("nation"), F.col("c_custkey").cast("long").alias("cust"), F.col("c_acctbal").cast("double").alias("bal"), F.row_number().over(w.orderBy("c_custkey")).alias("k"), F.count(F.lit(1)).over(w).alias("nn")).withColumn("parent_k", F.when(F.col("k") > 1, F.floor((F.col("k") - 2) / 3) + 1))


def components(spark: SparkSession, sf_dir: str, rich: bool = False) -> DataFrame:
    """Component rows of all networks: 1 kV bases, so an ohm is a per-unit impedance.

    ``rich`` networks have a second infeeder, at 1.03, that feeds the odd nations' transformers, ratios and taps other than
    1 and 0 on either side, and load ids that are unique in their network only.
    """
    c = customers(spark, sf_dir)
    parents = c.select(F.col("nation").alias("pn"), F.col("k").alias("pk"), F.concat(F.lit("C"), "cust").alias("pbus"))
    c = c.join(parents, (F.col("nation") == F.col("pn")) & (F.col("parent_k") == F.col("pk")), "left").withColumn("from_bus", F.coalesce("pbus", F.concat(F.lit("N"), "nation")))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("nation"), F.col("n_regionkey").cast("int").alias("n"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("n"))
    cons = lambda *ends: F.array(*[F.struct(e.alias("node")) for e in ends])
    limits = F.struct(F.lit(0.94).alias("v_min"), F.lit(1.06).alias("v_max"))
    name = lambda prefix, col: F.concat(F.lit(prefix), col)

    def rows(df: DataFrame, cid, ctype: str, **fields) -> DataFrame:
        # a field that a kind of component lacks is null in the common body
        body = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), BODY)
        return df.select("n", cid.alias("cid"), F.lit(ctype).alias("ctype"), body.alias("body"))

    k = F.col("nation")
    feed = F.when(k % 2 == 1, name("S", "n")).otherwise(name("R", "n")) if rich else name("R", "n")
    turns = F.when(k % 4 == 0, 1.02).otherwise(1.0) if rich else F.lit(1.0)
    taps = F.when(k % 3 == 1, 2.0).when(k % 3 == 2, -1.0).otherwise(0.0) if rich else F.lit(0.0)
    tap_side = F.when(k % 2 == 0, "primary").otherwise("secondary") if rich else F.lit("primary")
    loads = local_ids(c) if rich else c.withColumn("load_id", name("D", "cust"))
    r = F.lit(1.2) / F.col("nn") * (1 + F.col("cust") % 7)
    z = F.array(r, 0.4 * r)
    parts = [
        rows(region, name("I", "n"), "Infeeder", v_setpoint=F.lit(1.0), cons=cons(name("R", "n"))),
        rows(region, name("R", "n"), "Node", v_base=F.lit(1.0), user_data=limits),
        rows(nation, name("N", "nation"), "Node", v_base=F.lit(1.0), user_data=limits),
        rows(c, name("C", "cust"), "Node", v_base=F.lit(1.0), user_data=limits),
        rows(nation, name("T", "nation"), "Transformer", cons=cons(feed, name("N", "nation")), z=F.lit("[[0,0],[0.003,0.0012]]"), nom_turns_ratio=F.array(turns), taps=F.array(taps), tap_factor=F.lit(0.025), tap_side=tap_side, vector_group=F.when(F.col("nation") % 7 == 3, F.array(F.lit("Yd11"), F.lit("Dyn11"))).otherwise(F.array(F.lit("Dyn11"), F.lit("Dyn11"))), s_max=F.lit(300.0), v_winding_base=F.array(F.lit(1.0), F.lit(1.0))),
        rows(c, name("L", "cust"), "Line", cons=cons(F.col("from_bus"), name("C", "cust")), length=F.lit(1.0), z=F.to_json(z), z0=z, i_max=F.when(F.col("cust") % 5 == 0, F.lit(40.0))),
        rows(loads, F.col("load_id"), "Load", cons=cons(name("C", "cust"))),
    ]
    if rich:
        parts += [rows(region, name("J", "n"), "Infeeder", v_setpoint=F.lit(1.03), cons=cons(name("S", "n"))), rows(region, name("S", "n"), "Node", v_base=F.lit(1.0), user_data=limits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    units = F.struct(F.lit(1000.0).alias("voltage"), F.lit(1.0).alias("current"), F.lit(1000.0).alias("power"), F.lit(1.0).alias("impedance"))
    return out.withColumn("units", units)


def local_ids(c: DataFrame) -> DataFrame:
    """Customers with a ``load_id`` by their order in the network."""
    return c.withColumn("load_id", F.concat(F.lit("D"), F.row_number().over(Window.partitionBy("n").orderBy("cust"))))


def local_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, load_id, real_power_w, reactive_power_var) of the rich networks' loads."""
    return local_ids(customers(spark, sf_dir)).select("n", "load_id", F.col("bal").alias("real_power_w"), (0.4 * F.col("bal")).alias("reactive_power_var"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(load_id, real_power_w, reactive_power_var): a customer's balance as watts."""
    p = F.col("c_acctbal").cast("double")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("D"), "c_custkey").alias("load_id"), p.alias("real_power_w"), (0.4 * p).alias("reactive_power_var"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, load_id, real_power_w, reactive_power_var): events as kW, purchases as export."""
    p = F.when(F.col("event_type") == "purchase", -1).otherwise(1) * F.col("value").cast("double") * 1000
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("t"), F.concat(F.lit("D"), "user_id").alias("load_id"), p.alias("real_power_w"), (0.4 * p).alias("reactive_power_var"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(load_id, injection, consumption, reservation_l, reservation_u) with tiers from order lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    latest = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("kw"), F.col("l_discount").cast("double").alias("price"))
    tiers = latest.join(lines, latest["o_orderkey"] == lines["l_orderkey"]).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "kw", "price"))).alias("tiers"))
    pair = lambda s: F.array(s["kw"], s["price"])
    odd = lambda keep: F.transform(F.filter("tiers", lambda s: s["l_linenumber"] % 2 == keep), pair)
    return tiers.select(F.concat(F.lit("D"), "o_custkey").alias("load_id"), odd(1).alias("injection"), odd(0).alias("consumption"), F.lit(-5.0).alias("reservation_l"), F.lit(5.0).alias("reservation_u"))
