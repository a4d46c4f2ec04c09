"""The first broken candidate, found where it is swept, against candidates as rows of one power flow."""

import random

import pytest
from pyspark.sql import functions as F

from feederflow.operators import envelope, flow, network
from feederflow.sources import tables
from tests.test_trees import forest

TIMES = ("2026-01-01", "2026-01-02")


@pytest.fixture(scope="module")
def case(spark):
    """Two times, segments in two groups a side, and some branches rated."""
    branch, bus, _ = forest(spark, 5)
    rng, rows, base = random.Random(5), [], []
    for n, m in enumerate((40, 50, 60)):
        for t in TIMES:
            for k in range(m):
                if rng.random() < 0.5:
                    base.append((n, t, f"x{k}", rng.uniform(0, 2e-3), rng.uniform(-1e-3, 1e-3)))
                for oe in ("oel", "oer"):
                    before = rng.choice([0.0, 150.0])
                    rows.append((n, t, oe, f"x{k}", rng.uniform(1, 5), 150.0, before))
    time = F.col("t").cast("timestamp_ntz")
    base = spark.createDataFrame(base, "n int, t string, bus_id string, p_pu double, q_pu double").withColumn("t", time)
    segments = spark.createDataFrame(rows, "n int, t string, oe string, bus_id string, size_kw double, group_kw double, before double").withColumn("t", time)
    # ratios on two branches a network at most, so that some candidates keep the limits
    branch = branch.withColumns({"ratio_pu": F.when(F.col("branch_id").isin("b9", "b30"), F.col("ratio_pu")), "i_max_pu": F.when(F.col("branch_id").endswith("5"), 0.03)})
    bus = bus.withColumns({"v_min_pu": F.lit(0.9), "v_max_pu": F.lit(1.15)})
    tried = segments.select("n", "t", "oe").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("total", F.col("c") * 25.0)
    limits = branch.where("branch_id in ('b3', 'b11')").select("n", "branch_id", F.lit(0.02).alias("i_max_pu")).withColumn("t", F.lit(TIMES[1]).cast("timestamp_ntz"))
    return [tables.stored(x, "case") for x in (network.tree_labels(branch), branch, bus, base, segments, tried, limits)]


@pytest.mark.parametrize("by_time, broken", [(True, True), (False, False)])
def test_first_candidate_is_that_of_the_rows(case, by_time, broken):
    tree, branch, bus, base, segments, tried, limits = case
    if not by_time:
        segments = segments.where(F.col("t") == F.lit(TIMES[0]).cast("timestamp_ntz")).drop("t")
    small, rows = ({(r.n, r.t, r.oe): r.first for r in envelope._first(tree, branch, bus, base, segments, tried, broken, limits, 60, most).collect()} for most in (200_000, 0))
    assert small == rows and len(small) > 4 and (not broken or len(set(small.values())) > 2)


@pytest.mark.parametrize("by_time, broken", [(True, True), (False, False)])
def test_large_networks_are_judged_by_pieces(case, by_time, broken, monkeypatch):
    """Feeders don't depend on each other, so no candidate of a network above ``most_branches`` is a row."""
    tree, branch, bus, base, segments, tried, limits = case
    if not by_time:
        segments = segments.where(F.col("t") == F.lit(TIMES[0]).cast("timestamp_ntz")).drop("t")
    monkeypatch.setattr(envelope, "power_flow", None)
    want, got = ({(r.n, r.t, r.oe): r.first for r in envelope._first(tree, branch, bus, base, segments, tried, broken, limits, 60, most).collect()} for most in (200_000, 45))
    assert got == want and len(got) > 4
    cut, whole = flow.pieces(tree, 12)
    assert whole is None and cut.groupBy("of").agg(F.count_distinct("n").alias("k")).where("k > 1").count() > 0
    assert cut.groupBy("n").agg(F.min("enter").alias("a"), F.max("leave").alias("b"), F.count(F.lit(1)).alias("m")).where("a <> 0 or b <> m").isEmpty()
    got = {(r.n, r.t, r.oe): r.first for r in envelope._first(tree, branch, bus, base, segments, tried, broken, limits, 60, 12).collect()}
    assert got == want


def test_flow_by_pieces(case, monkeypatch):
    """The same flows in pieces; a case without loads in a piece is listed there too."""
    tree, branch, bus, base, *_ = case
    nodal = base.where("n < 2").withColumn("oe", F.lit("oel")).unionByName(base.where("n = 2").limit(1).withColumn("oe", F.lit("oel")))
    rows = lambda df: {tuple(r[k] for k in ("n", "t", "oe", "branch_id")): (r.p_pu, r.q_pu, r.l_pu) for r in df.collect()}
    want = rows(flow.power_flow(tree, branch, bus, nodal)[0])
    monkeypatch.setattr(flow, "_ranged", None)
    monkeypatch.setattr(flow, "CELLS", 30)
    got = rows(flow.power_flow(tree, branch, bus, nodal, most_branches=12)[0])
    assert got.keys() == want.keys() and len(want) == 2 * (39 + 48) + 59
    for k, v in want.items():
        assert v == pytest.approx(got[k], abs=1e-10, nan_ok=True)


def test_candidates_are_dealt_to_several_tasks(case, monkeypatch):
    tree, branch, bus, base, segments, tried, limits = case
    want = sorted(flow.first_candidate(tree, branch, bus, base, segments, tried, True, limits).collect(), key=str)
    # one candidate at a time in tasks of one cell each
    monkeypatch.setattr(flow, "TASK_CASES", 1)
    monkeypatch.setattr(flow, "CELLS", 50)
    assert sorted(flow.first_candidate(tree, branch, bus, base, segments, tried, True, limits).collect(), key=str) == want


def test_search_makes_no_rows_of_candidates(case, monkeypatch):
    tree, branch, bus, base, segments, *_ = case
    load = bus.select("n", F.col("bus_id").alias("load_id"), "bus_id")
    readings = load.join(tree.select("n", "bus_id"), ["n", "bus_id"]).select("n", "load_id", F.lit(TIMES[0]).cast("timestamp_ntz").alias("t"), F.lit(100.0).alias("real_power_w"), F.lit(50.0).alias("reactive_power_var"))
    monkeypatch.setattr(envelope, "power_flow", None)
    got = envelope.envelope_search(tree, branch, bus, load, readings, load.select("n", "load_id"), grid=4, rounds=2)
    assert got.where("feasible and ub_kw > 0").count() > 0
    assert envelope.required_shed(tree, branch, bus, load, readings, rounds=1).where("restored").count() > 0
