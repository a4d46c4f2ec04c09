"""Published results: envelopes of twelve steps with temperatures carried, currents that the limit allows, and required relief."""

import pytest
from pyspark.sql import functions as F

from feederflow.operators import envelope, flow, matching, thermal
from feederflow.sources import tables
from tests.test_physics import net  # noqa: F401

# fixed values: watts of the twelve half hours by load (vars are 0.4 of them), air temperatures, published totals and temperatures
CLOCK = [f"{h:02d}:{m:02d}" for h in range(7, 13) for m in (0, 30)]
WATTS = {"1001": [1000, 2000, 3000, 4000, 5000, 6000], "1002": [700, 1400, 2000, 2500, 3000, 3500], "1003": [500, 1000, 1500, 2000, 2500, 3000], "1004": [1500, 3000, 4500, 6000, 7000, 8000]}
AIR = [7.3, 7.5, 7.7, 7.65, 7.6, 8.3, 9.0, 9.55, 10.1, 10.4, 10.7, 11.05]
IMPORT = [-11.519489, -11.051614, -10.584926, -10.119763, -9.73271, -9.340914, -9.340914, -9.732669, -10.119722, -10.584926, -11.051614, -11.519489]
EXPORT = [(13.89479, 0.149379), (14.093305, 0.318046), (14.292688, 0.481394), (14.485709, 0.646421), (14.672752, 0.769469), (13.925112, 1.350052), (13.609641, 1.504455), (14.141208, 1.027972), (14.486942, 0.645172), (14.292688, 0.481394), (14.093309, 0.318041), (13.894297, 0.149873)]
TOP_OIL = [27.39, 42.662, 50.797, 54.809, 56.657, 57.335, 57.747, 58.439, 59.444, 60.976, 63.033, 65.621]
HOT_SPOT = [64.372, 78.625, 85.573, 88.394, 89.463, 90.29, 91.394, 93.176, 95.452, 98.416, 102.16, 106.745]
PARAMS = (60.0, 7.0, 55.0, 23.0, 6.0, 0.8, 0.8, 50.0, 120.0, 30.0)


def at(col):
    return F.concat(F.lit("2026-06-29 "), col).cast("timestamp_ntz")


def steps(spark):
    """A step's watts mirror those of the second half; the first load's vars are 0.4 of its watts, as of all."""
    day = lambda w: [*w, *reversed(w)]
    rows = [(c, i, float(p)) for i, w in WATTS.items() for c, p in zip(CLOCK, day(w), strict=True)]
    r = spark.createDataFrame(rows, "c string, load_id string, real_power_w double")
    air = spark.createDataFrame(list(zip(CLOCK, AIR, strict=True)), "c string, theta_a double").select(at(F.col("c")).alias("t"), "theta_a")
    return r.select(at(F.col("c")).alias("t"), "load_id", "real_power_w", (0.4 * F.col("real_power_w")).alias("reactive_power_var")), air


def test_twelve_steps_with_temperatures_carried(spark, net):  # noqa: F811
    bus, load, branch, tree = net
    r, air = steps(spark)
    params = spark.createDataFrame([PARAMS], tables.TX_PARAMS)
    out = envelope.multistep_envelopes(tree, branch, bus, load, r, load.select("n", "load_id"), air, params, "nearest", grid=128)
    kw = out["envelope"].groupBy("t").agg(F.sum("lb_kw").alias("lb"), F.sum("ub_kw").alias("ub")).orderBy("t").collect()
    for row, lb, (a, b) in zip(kw, IMPORT, EXPORT, strict=True):
        assert row.lb == pytest.approx(2 * lb - 5.4e-5, abs=4e-4 + 200 / 128**3)
        assert row.ub == pytest.approx(2 * (a + b), rel=6e-4)
    warm = out["thermal"].orderBy("t").collect()
    for row, oil, hot in zip(warm, TOP_OIL, HOT_SPOT, strict=True):
        assert (row.delta_theta_TO, row.theta_HS) == (pytest.approx(oil, abs=2e-3), pytest.approx(hot, abs=2e-3)) and row.solved
    # the export side's currents at the steps where the hot spot binds
    amps = {str(x.t)[11:16]: x.current_a_oer for x in out["branch"].where("branch_id = 'tx1'").collect()}
    for clock, binding in (("09:30", 71.918), ("10:00", 71.248), ("10:30", 70.761)):
        assert amps[clock] == pytest.approx(binding, abs=5e-3) and amps[clock] <= binding + 1e-3


def test_flows_of_all_steps_are_made_once(spark, net, monkeypatch):  # noqa: F811
    """Later flows are those of changed steps alone, and what is returned is that of each step's last envelope."""
    bus, load, branch, tree = net
    r, air = steps(spark)
    counts, real = [], envelope.power_flow
    monkeypatch.setattr(envelope, "power_flow", lambda tree, branch, bus, nodal, *a, **b: counts.append(nodal.select("t").distinct().count()) or real(tree, branch, bus, nodal, *a, **b))
    out = envelope.multistep_envelopes(tree, branch, bus, load, r, load.select("n", "load_id"), air, spark.createDataFrame([(*PARAMS[:8], 95.0, 30.0)], tables.TX_PARAMS), "nearest", grid=64, rounds=2)
    assert counts[0] == 12 and len(counts) > 1 and max(counts[1:]) < 12
    sides = F.explode(F.array(F.struct(F.lit("oel").alias("oe"), F.col("lb_kw").alias("kw")), F.struct(F.lit("oer").alias("oe"), F.col("ub_kw").alias("kw"))))
    e = out["envelope"].select("n", "t", "load_id", sides.alias("s")).select("n", "t", "load_id", "s.*")
    want = flow.voltage_current_results(*real(tree, branch, bus, matching.nodal_allocation(load, r, e))[:2], branch)
    for name, df in zip(("bus", "branch"), want, strict=True):
        assert sorted(map(str, out[name].collect())) == sorted(map(str, df.collect()))


def test_steps_without_a_solution_keep_the_temperatures(spark, net):  # noqa: F811
    bus, load, branch, tree = net
    r, air = steps(spark)
    r = r.where("t <= timestamp_ntz'2026-06-29 08:00:00'").withColumn("reactive_power_var", F.when(F.col("t") == F.lit("2026-06-29 07:30:00").cast("timestamp_ntz"), 200_000.0).otherwise(F.col("reactive_power_var")))
    params = spark.createDataFrame([PARAMS], tables.TX_PARAMS)
    runs = {}
    for source in ("oel", "oer", "max"):
        out = envelope.multistep_envelopes(tree, branch, bus, load, r, load.select("n", "load_id"), air, params, grid=8, rounds=2, state_from=source)
        runs[source] = out["thermal"].orderBy("t").collect()
        warm = runs[source]
        assert [x.solved for x in warm] == [True, False, True]
        assert (warm[1].delta_theta_TO, warm[1].delta_theta_HS) == (warm[0].delta_theta_TO, warm[0].delta_theta_HS) and warm[2].delta_theta_TO != warm[1].delta_theta_TO
        amps = {str(x.t)[11:16]: x for x in out["branch"].where("branch_id = 'tx1'").collect()}["07:00"]
        heat = {"oel": amps.current_a_oel, "oer": amps.current_a_oer, "max": max(amps.current_a_oel, amps.current_a_oer)}[source]
        given = spark.createDataFrame([("tx1", heat)], "tx_id string, current_a double")
        top = thermal.ultimate_rise(thermal.load_factor(given, params), params).head().to_u * (1 - 2.718281828459045**-0.5)
        assert warm[0].delta_theta_TO == pytest.approx(top, abs=1e-5)
    with pytest.raises(ValueError, match="state_from"):
        envelope.multistep_envelopes(tree, branch, bus, load, r, load, air, params, state_from="both")


def test_published_relief(spark, net):  # noqa: F811
    bus, load, branch, tree = net
    given = spark.createDataFrame([("1001", 12000.0, 4000.0), ("1002", 3000.0, 1200.0), ("1003", 2500.0, 900.0), ("1004", 11000.0, 3500.0)], "load_id string, real_power_w double, reactive_power_var double").withColumn("t", F.lit("2026-06-29").cast("timestamp_ntz"))
    row = envelope.required_shed(tree, branch, bus, load, given, grid=64).head()
    assert (row.bus_id, row.restored) == ("bus_b", True) and row.shed_kw == pytest.approx(11.930589, abs=3e-4)
