"""What larger and odder tables showed: frames, zeros, and sums on a limit."""

import os
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feederflow.operators import flow, matching, network, synth
from feederflow.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_many_times_in_an_hour_are_read_in_one_pass(spark):
    rng = np.random.default_rng(3)
    at = pd.Timestamp("2024-01-01 07:00") + pd.to_timedelta(rng.integers(0, 3_600_000_000, 60_000), unit="us")
    times = spark.createDataFrame(pd.DataFrame({"us": at.astype("datetime64[us]").astype("int64")})).select(F.timestamp_micros("us").cast("timestamp_ntz").alias("t"))
    hours = [("2024-01-01 05:00:00", 4.0), ("2024-01-01 07:30:00", 9.0), ("2024-01-01 09:00:00", 3.0)]
    air = spark.createDataFrame(hours, "t string, theta_a double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = matching.ambient_at(times, air)
    # a frame that ends with the partition is read anew for each row
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = out.toPandas()
    seconds = lambda t: (pd.DatetimeIndex(t) - pd.Timestamp("2024-01-01")).total_seconds()
    want = np.interp(seconds(got["t"]), seconds([h for h, _ in hours]), [a for _, a in hours])
    assert len(got) == len(set(at)) and np.abs(got["theta_a"] - want).max() < 1e-9 and not got["extrapolated"].any()


def test_zero_slack_is_listed_where_asked(spark):
    slack = spark.createDataFrame([(0, "a", "oel", 0.0, 0.0), (0, "b", "oel", 1.0, 0.0)], "n int, bus_id string, oe string, a_kw double, r_kw double")
    assert [r.bus_id for r in flow.viol_report(slack, ("n",)).collect()] == ["b"]
    assert sorted(r.bus_id for r in flow.viol_report(slack, ("n",), zeros=True).collect()) == ["a", "b"]


def test_sums_on_a_tie_round_up_in_any_order(spark):
    """30.2085 as a sum of terms that binary fractions add to less."""
    parts = [1.6969, 3.3507, 3.1846, 21.9763]
    assert sum(parts) < 30.2085 and sum(parts[::-1]) < 30.2085
    t = "timestamp_ntz'2024-01-01 00:00:00'"
    e = spark.createDataFrame([(0, str(k), 0.0, 1000 * w) for k, w in enumerate(parts)], "n int, load_id string, lb_kw double, ub_kw double").withColumn("t", F.expr(t))
    pay = spark.createDataFrame([(0, str(k), w) for k, w in enumerate(parts)], "n int, load_id string, payment_dlr double").withColumn("t", F.expr(t))
    prices = spark.createDataFrame([], "load_id string, export_price_kwh double")
    got = flow.objective_value(pay, prices, e, e.select("n", "t", F.lit(0.0).alias("kw"))).select(F.round("cost", 3).alias("cost"), F.round("width", 3).alias("width")).head()
    assert (got.cost, got.width) == (30.209, 30.209)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_dispatch_on_its_cap_and_readings_of_unknown_loads(spark, tmp_path):
    """Three readings that sum to the offer of 3 kW, to 30000.000000000004 W in one order; a reading of a load that no network has."""
    for name in ("region", "nation", "customer"):
        shutil.copy(f"{DIR}/{name}.parquet", tmp_path)
    ts = F.lit("2024-01-01 10:00:00").cast("timestamp")
    rows = [(0, 1, "view", 4.03), (1, 1, "view", 16.01), (2, 1, "view", 9.96), (3, 10**6, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", ts).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 3.0, 0.1)], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.load_id, r.ci): r.ok for r in QUERIES["offer_cap_check"](spark, str(tmp_path)).collect()}
    assert got == {("D1", "inj"): True, ("D1", "con"): True}


def test_customers_times_are_not_sorted_to_be_smoothed(spark):
    """The product of customers and times meets no window; sums over customers are the totals."""
    series = spark.createDataFrame([(f"2024-01-01 {h:02d}:00:00", 5.0 - h) for h in range(9)], "t string, total_kw double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    each = synth.disaggregate(series, synth.customer_roster(spark, 20, 0.3, {"a": 0.5, "b": 0.5}))
    plan = each._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(load_id" not in plan and "windowspecdefinition(t" in plan
    assert each.count() == 180 and synth.sum_check(each, series).head().ok


def test_labels_broadcast_no_branches(spark, monkeypatch):
    plans, real = [], network.stored
    monkeypatch.setattr(network, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    branch = spark.createDataFrame([(0, f"b{k}", f"x{(k - 1) // 2}", f"x{k}") for k in range(1, 30)], "n int, branch_id string, from_bus string, to_bus string")
    assert network.tree_labels(branch).count() == 29
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
