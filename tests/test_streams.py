"""Temperatures of networks' transformers from a stream: gaps, late rows, nested transformers, against a plain loop."""

import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feederflow.operators import matching, network, thermal
from feederflow.sources import tables
from feederflow.streaming import thermal as stream

PARAMS = {"tau_TO": 180.0, "tau_W": 10.0, "delta_theta_TO_R": 55.0, "delta_theta_HS_R": 23.0, "R": 6.0, "n_exp": 0.8, "m_exp": 0.8, "I_rated": 20.0, "theta_HS_max": 120.0, "dt": 60.0}


@pytest.fixture(scope="module")
def nested(spark):
    """A transformer below another: (load, branch, tree)."""
    branch = spark.createDataFrame([(0, "t1", "hv", "a", 1.0, 1000.0), (0, "l1", "a", "b", None, 1000.0), (0, "t2", "b", "c", 1.0, 500.0), (0, "l2", "c", "d", None, 500.0), (1, "t1", "hv", "a", 1.0, 1000.0)], "n int, branch_id string, from_bus string, to_bus string, ratio_pu double, i_base_a double").withColumn("r_pu", F.lit(0.01))
    load = spark.createDataFrame([(0, "x", "a"), (0, "y", "d"), (1, "x", "a"), (1, "z", "hv")], "n int, load_id string, bus_id string")
    return load, branch, network.tree_labels(branch)


def test_loads_of_transformers(nested):
    load, branch, tree = nested
    got = sorted((r.n, r.load_id, r.tx_id, r.i_base_a) for r in network.transformer_loads(tree, branch, load).collect())
    assert got == [(0, "x", "t1", 1000.0), (0, "y", "t1", 1000.0), (0, "y", "t2", 500.0), (1, "x", "t1", 1000.0)]


def test_gaps_and_late_rows(spark, nested, tmp_path):
    load, branch, tree = nested
    loads = tables.stored(network.transformer_loads(tree, branch, load), "loads")
    hour = lambda h, m=0: pd.Timestamp("2026-01-01") + pd.Timedelta(hours=h, minutes=m)
    batches = [
        [(0, "x", hour(0, 10), 9000.0), (0, "y", hour(0, 20), 4000.0), (0, "x", hour(1, 5), 8000.0), (0, "x", hour(5, 30), 7000.0)],
        [(0, "y", hour(5, 45), 3000.0), (1, "x", hour(6, 0), 6000.0)],
        # the second batch has closed the hour of the first row, which comes too late
        [(0, "x", hour(1, 50), 50_000.0), (0, "q", hour(12, 0), 1.0)],
    ]
    folder = tmp_path / "readings"
    folder.mkdir()
    for k, rows in enumerate(batches):
        path = folder / f"{k}.parquet"
        frame = pd.DataFrame(rows, columns=["n", "load_id", "t", "real_power_w"]).assign(reactive_power_var=lambda f: 0.4 * f.real_power_w).astype({"n": "int32"})
        frame["t"] = frame["t"].astype("datetime64[us]").dt.tz_localize("UTC")
        frame.to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + 100 * k,) * 2)
    own = stream.rocks_session(spark)
    params = own.createDataFrame([tuple(PARAMS.values())], ", ".join(f"{k} double" for k in PARAMS))
    readings = own.readStream.schema("n int, load_id string, t timestamp, real_power_w double, reactive_power_var double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    static = own.read.schema(loads.schema).parquet(*loads.inputFiles())
    got = {(r.n, r.tx_id, r.t): r for r in stream.drained(spark, stream.network_thermal_stream(readings, static, params)).collect()}
    watts = {(0, "t1"): {0: 13_000.0, 1: 8000.0, 5: 10_000.0}, (0, "t2"): {0: 4000.0, 5: 3000.0}, (1, "t1"): {6: 6000.0}}
    base, want = {(0, "t1"): 1000.0, (0, "t2"): 500.0, (1, "t1"): 1000.0}, set()
    for key, by_hour in watts.items():
        to = hs = 0.0
        # the watermark ends an hour before the last reading, that of an unknown load
        for h in range(min(by_hour), 11):
            amps = by_hour.get(h, 0.0) * math.sqrt(1 + 0.4**2) / 1e6 * base[key]
            k2 = (amps / PARAMS["I_rated"]) ** 2
            to += (55 * ((k2 * 6 + 1) / 7) ** 0.8 - to) * (1 - math.exp(-60 / 180))
            hs += (23 * k2**0.8 - hs) * (1 - math.exp(-6))
            r = got[(*key, hour(h).to_pydatetime())]
            assert (r.current_a, r.delta_theta_TO, r.delta_theta_HS) == (pytest.approx(amps), pytest.approx(to), pytest.approx(hs, abs=1e-9))
            want.add((*key, hour(h).to_pydatetime()))
    assert got.keys() == want


def test_series_of_two_stations(spark):
    air = spark.createDataFrame([("a", "2026-01-01 00:00:00", 10.0), ("a", "2026-01-03 00:00:00", 14.0), ("b", "2026-01-01 12:00:00", 0.0), ("b", "2026-01-01 12:00:00", 4.0)], "station string, t string, theta_a double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    times = spark.createDataFrame([(s, t) for s in "abc" for t in ("2025-12-30 00:00:00", "2026-01-02 12:00:00", "2026-01-03 00:00:00", "2026-02-01 00:00:00")], "station string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {(r.station, str(r.t)[:10]): (r.theta_a, r.extrapolated) for r in matching.ambient_at(times, air, ("station",)).collect()}
    assert got == {("a", "2025-12-30"): (10.0, True), ("a", "2026-01-02"): (13.0, False), ("a", "2026-01-03"): (14.0, False), ("a", "2026-02-01"): (14.0, True), **{("b", d): (2.0, True) for d in ("2025-12-30", "2026-01-02", "2026-01-03", "2026-02-01")}}


def test_steps_written_again_leave_the_others(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"2026-01-0{d} 0{h}:00:00", 1.0) for n in (0, 1) for d in (1, 2) for h in (1, 2)], "n int, t string, kw double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    path = str(tmp_path / "out")
    tables.write_results({"x": rows}, path)
    tables.write_results({"x": rows.where("n = 1 and to_date(t) = '2026-01-02'").withColumn("kw", F.lit(9.0))}, path)
    got = sorted((r.n, str(r.day), r.kw) for r in spark.read.parquet(f"{path}/x").collect())
    assert got == sorted((n, f"2026-01-0{d}", 9.0 if (n, d) == (1, 2) else 1.0) for n in (0, 1) for d in (1, 2) for _ in (1, 2))


def test_damaged_documents_are_told(spark):
    good = '{"units": {"voltage": 1}, "components": {"a": {"Node": {"v_base": 1.0}}}}'
    docs = spark.createDataFrame([(0, good), (1, good[:30]), (2, None), (3, "{}"), (4, good.replace("1.0", '"high"')), (5, '{"components": {"a": 3}}'), (6, "[1, 2]")], "n int, doc string")
    components = tables.components_of(docs)
    got = {(r.n, r.rule, r.cid) for r in network.network_quality(components, docs).where("rule in ('not_json', 'no_components', 'bad_value')").collect()}
    assert got == {(1, "not_json", ""), (2, "not_json", ""), (3, "no_components", ""), (4, "bad_value", "a"), (5, "bad_value", "a"), (6, "not_json", "")}, got


def test_keys_by_time_and_network(spark):
    t = lambda df: df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    load = spark.createDataFrame([(0, "1", "a"), (1, "1", "a")], "n int, load_id string, bus_id string")
    bus = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "n int, bus_id string")
    r = t(spark.createDataFrame([(0, "2026-01-01", "1", 1000.0, 0.0), (0, "2026-01-02", "1", 3000.0, 0.0), (1, "2026-01-01", "1", 500.0, 100.0)], "n int, t string, load_id string, real_power_w double, reactive_power_var double"))
    got = sorted((x.n, str(x.t)[:10], x.bus_id, x.p_kw) for x in matching.bus_background_load(bus, load, r, load.limit(0)).collect())
    assert got == [(0, "2026-01-01", "a", 1.0), (0, "2026-01-01", "b", 0.0), (0, "2026-01-02", "a", 3.0), (0, "2026-01-02", "b", 0.0), (1, "2026-01-01", "a", 0.5)]
    from feederflow.operators import envelope, flow, reshape

    e = t(spark.createDataFrame([(0, "2026-01-01", "1", -1.0, 2.0), (0, "2026-01-02", "1", -3.0, 5.0)], "n int, t string, load_id string, lb_kw double, ub_kw double"))
    pay, slack = e.select("n", "t", "load_id", F.lit(1.0).alias("payment_dlr")), e.select("n", "t", F.lit(0.0).alias("kw")).limit(0)
    widths = {str(x.t)[:10]: round(x.width, 9) for x in flow.objective_value(pay, e.select("n", "load_id", F.lit(0.1).alias("export_price_kwh")).distinct(), e, slack).collect()}
    assert widths == {"2026-01-01": 0.003, "2026-01-02": 0.008}
    offers = spark.createDataFrame([("1", [[2.0, 0.1]], [[1.0, 0.1]], -4.0, 4.0)], "load_id string, injection array<array<double>>, consumption array<array<double>>, reservation_l double, reservation_u double")
    d = e.select("n", "t", "load_id", F.when(F.dayofmonth("t") == 1, 0.0).otherwise(1.0).alias("dispatch_kw"))
    short = {str(x.t)[:10]: (x.short_l_kw, x.short_u_kw) for x in envelope.reservation_check(e, offers, d).collect()}
    assert short == {"2026-01-01": (3.0, 2.0), "2026-01-02": (0.0, 0.0)}
    caps = {str(x.t)[:10]: x.ok for x in envelope.offer_cap_check(d.select("n", "t", "load_id", F.lit("inj").alias("ci"), (3 * F.col("dispatch_kw")).alias("kw")), offers).collect()}
    assert caps == {"2026-01-01": True, "2026-01-02": False}
    gaps = sorted((x.n, x.kind) for x in reshape.interval_check(r.select("n", "load_id", "t"), 60).collect())
    assert gaps == [(0, "gap")]
    warm = t(spark.createDataFrame([("tx", "2026-01-01", 119.0), ("tx", "2026-01-02", 125.0)], "tx_id string, t string, theta_HS double"))
    params = spark.createDataFrame([tuple(PARAMS.values())], ", ".join(f"{k} double" for k in PARAMS))
    assert [(x.theta_HS, x.over) for x in thermal.hotspots_over(warm, params).collect()] == [(125.0, 5.0)]
