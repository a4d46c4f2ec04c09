"""Networks with equal load ids, cycles, large networks by joins, required relief, and parameters by transformer."""

import pytest
from pyspark.sql import functions as F

from feederflow.operators import envelope, flow, matching, network, thermal
from feederflow.sources import tables
from tests.test_physics import FORECAST, net, readings  # noqa: F401


def test_equal_ids_in_two_networks(spark):
    load = spark.createDataFrame([(0, "1001", "a"), (1, "1001", "a")], "n int, load_id string, bus_id string")
    own = spark.createDataFrame([(0, "1001", 3000.0, 0.0), (1, "1001", 500.0, 0.0)], "n int, load_id string, real_power_w double, reactive_power_var double").withColumn("t", F.lit("2026-01-01").cast("timestamp_ntz"))
    got = {(r.n, r.oe): r.p_pu for r in matching.nodal_allocation(load, own, None).collect()}
    assert got == {(0, "oel"): 0.003, (0, "oer"): 0.003, (1, "oel"): 0.0005, (1, "oer"): 0.0005}
    one = own.where("n = 1")
    assert [r.n for r in matching.participants(load, one).collect()] == [1]
    assert matching.unmatched_ids(one, one, load).where("source = 'network'").collect()[0].n == 0


def test_cycles_are_reported(spark):
    ring = spark.createDataFrame([(0, "x", "a", "b"), (0, "y", "b", "a"), (1, "z", "r", "a")], "n int, branch_id string, from_bus string, to_bus string")
    with pytest.raises(ValueError, match="cycle"):
        network.tree_closure(ring)
    assert network.tree_closure(ring.where("n = 1")).count() == 1


def test_large_networks_by_joins_agree(net, readings):  # noqa: F811
    bus, load, branch, tree = net
    nodal = matching.nodal_allocation(load, readings, None)
    swept, joined = (flow.power_flow(tree, branch, bus, nodal, most_branches=m) for m in (200_000, 0))
    for a, b, key in zip(swept[:2], joined[:2], ("branch_id", "bus_id"), strict=True):
        x, y = ({(r.oe, r[key]): r for r in df.collect()} for df in (a, b))
        assert x.keys() == y.keys()
        for k, r in x.items():
            for c in ("p_pu", "q_pu", "l_pu", "v2_pu"):
                if c in a.columns:
                    assert r[c] == pytest.approx(y[k][c], abs=1e-11)
    assert all(r.converged and 2 < r.passes < 20 for df in (swept[2], joined[2]) for r in df.collect())


def test_more_passes_change_nothing(net, readings):  # noqa: F811
    bus, load, branch, tree = net
    nodal = matching.nodal_allocation(load, readings, None)
    few, many = ({(r.oe, r.bus_id): r.v2_pu for r in flow.power_flow(tree, branch, bus, nodal, passes=p)[1].collect()} for p in (20, 60))
    assert few == many


def test_relief_restores_the_limits_or_is_null(net, readings):  # noqa: F811
    bus, load, branch, tree = net
    heavy = matching.scale_loads(readings, [2.5]).drop("factor")
    row = envelope.required_shed(tree, branch, bus, load, heavy, rounds=3).head()
    assert row.restored and row.shed_kw > 0
    nodal = matching.nodal_allocation(load, heavy, None).where("oe = 'oel'")
    for kw, fine in ((row.shed_kw, True), (row.shed_kw - 27.5 / 16**3 - 1e-6, False)):
        less = nodal.withColumn("p_pu", F.col("p_pu") - F.when(F.col("bus_id") == row.bus_id, kw / 1e3).otherwise(0.0))
        f, v, _ = flow.power_flow(tree, branch, bus, less)
        assert (flow.limit_violations(f, v, branch, bus).count() == 0) == fine
    # reactive power alone breaks the limits: no active relief helps
    worse = readings.withColumns({"real_power_w": F.lit(0.0), "reactive_power_var": F.lit(150_000.0)})
    lost = envelope.required_shed(tree, branch, bus, load, worse, rounds=1).head()
    assert lost.shed_kw is None and not lost.restored


def test_parameters_by_transformer(spark):
    two = spark.createDataFrame([("a", 60.0, 7.0, 55.0, 23.0, 6.0, 0.8, 0.8, 50.0, 120.0, 30.0), ("b", 60.0, 7.0, 55.0, 23.0, 6.0, 0.8, 0.8, 100.0, 120.0, 30.0)], f"tx_id string, {tables.TX_PARAMS}")
    amps = spark.createDataFrame([("a", 50.0), ("b", 50.0)], "tx_id string, current_a double")
    assert {r.tx_id: r.k2 for r in thermal.load_factor(amps, two).collect()} == {"a": 1.0, "b": 0.25}
    with pytest.raises(Exception, match="one set of transformer parameters"):
        thermal.load_factor(amps, two.drop("tx_id")).collect()


def test_temperatures_over_many_days(spark):
    """The chained scan against a plain loop over 100 days, with hours that keep the state."""
    params = spark.createDataFrame([(180.0, 10.0, 55.0, 23.0, 6.0, 0.8, 0.8, 50.0, 120.0, 60.0)], tables.TX_PARAMS)
    t = spark.range(0, 2_400, 5).select((F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("t"), "id")
    rise = t.select(F.lit("a").alias("tx_id"), "t", F.when(F.col("id") % 35 != 0, 40.0 + F.col("id") % 7).alias("to_u"), F.when(F.col("id") % 35 != 0, 10.0 + F.col("id") % 3).alias("hs_u"))
    got = thermal.thermal_series(rise, t.select("t", F.lit(20.0).alias("theta_a")), params).orderBy("t").collect()
    import math

    x = y = 0.0
    for r, (to, hs) in zip(got, [(r.to_u, r.hs_u) for r in rise.orderBy("t").collect()], strict=True):
        if to is not None:
            x, y = (to - x) * (1 - math.exp(-60 / 180)) + x, (hs - y) * (1 - math.exp(-6)) + y
        assert (r.delta_theta_TO, r.delta_theta_HS) == (pytest.approx(x, abs=1e-9), pytest.approx(y, abs=1e-9))
