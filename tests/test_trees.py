"""Tree labels, running sums over ranges, and flows of random trees with one or two infeeders, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feederflow.functions.running import dealt_in_order, sums_before
from feederflow.operators import envelope, flow, network
from feederflow.sources import tables

KEYS = ("n", "t", "oe")


def forest(spark, seed):
    """Network 0 has one infeeder, network 1 two with their own set points, network 2 is a long feeder; some branches have ratios."""
    rng = random.Random(seed)
    branch, bus, nodal = [], [], []
    for n, m in enumerate((40, 50, 60)):
        roots = (0, 7) if n == 1 else (0,)
        for k in range(m):
            bus.append((n, f"x{k}", {0: 1.02, 7: 1.05}[k] if k in roots else None, 0.94, 1.06))
            if k not in roots:
                up = rng.choice([j for j in range(max(0, k - (1 if n == 2 else 8)), k)])
                branch.append((n, f"b{k}", f"x{up}", f"x{k}", rng.uniform(1e-4, 0.01), rng.uniform(1e-4, 0.01), rng.choice([None, None, 0.98, 1.03])))
            for oe in ("oel", "oer"):
                if rng.random() < 0.6:
                    nodal.append((n, oe, f"x{k}", rng.uniform(-0.01, 0.02), rng.uniform(-0.01, 0.01)))
    b = spark.createDataFrame(branch, "n int, branch_id string, from_bus string, to_bus string, r_pu double, x_pu double, ratio_pu double")
    s = spark.createDataFrame(bus, "n int, bus_id string, v_set_pu double, v_min_pu double, v_max_pu double")
    p = spark.createDataFrame(nodal, "n int, oe string, bus_id string, p_pu double, q_pu double").withColumn("t", F.lit("2026-01-01").cast("timestamp_ntz"))
    return tables.stored(b, "b"), tables.stored(s, "s"), tables.stored(p, "p")


@pytest.fixture(scope="module")
def trees(spark):
    b, s, p = forest(spark, 1)
    return b, s, p, network.tree_labels(b)


def paths(branch):
    """{(n, bus): branches from it up}"""
    to = {(r.n, r.to_bus): r for r in branch}
    out = {}
    for key in to:
        own, x = [], key
        while x in to:
            own.append(to[x])
            x = (x[0], to[x].from_bus)
        out[key] = (own, x[1])
    return out


def test_labels(trees):
    branch, _, _, tree = trees
    up, got = paths(branch.collect()), {(r.n, r.bus_id): r for r in tree.collect()}
    assert got.keys() == up.keys()
    for key, r in got.items():
        own, root = up[key]
        assert (r.root, r.depth) == (root, len(own) - 1)
        assert r.rho == pytest.approx(np.prod([(b.ratio_pu or 1) ** 2 for b in own])) and r.path_r == pytest.approx(sum(b.r_pu for b in own))
    for n in {k[0] for k in got}:
        mine = [r for k, r in got.items() if k[0] == n]
        assert sorted(r.enter for r in mine) == list(range(len(mine)))
        for a in mine:
            under = {k[1] for k, (own, _) in up.items() if k[0] == n and any(b.branch_id == a.branch_id for b in own)}
            assert under == {r.bus_id for r in mine if a.enter <= r.enter < a.leave}


def test_sums_over_the_tree(trees):
    branch, bus, nodal, tree = trees
    up, sets = paths(branch.collect()), {(r.n, r.bus_id): r.v_set_pu for r in bus.collect()}
    loads = nodal.collect()
    want = {}
    for x in loads:
        for b in up.get((x.n, x.bus_id), ([], None))[0]:
            p, q = want.get((x.n, x.oe, b.branch_id), (0.0, 0.0))
            want[x.n, x.oe, b.branch_id] = (p + x.p_pu, q + x.q_pu)
    f = tables.stored(flow.subtree_flow(tree, nodal, width=7), "f")
    got = {(r.n, r.oe, r.branch_id): (r.p_pu, r.q_pu) for r in f.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)
    volts = {(r.n, r.oe, r.bus_id): r.v2_pu for r in flow.path_voltage(tree, branch, bus, f, width=7).collect()}
    assert any(k[0] == 1 for k in volts)
    for (n, oe, b), v in volts.items():
        own, root = up[n, b]
        v2 = sets[n, root] ** 2
        for x in reversed(own):
            p, q = want.get((n, oe, x.branch_id), (0.0, 0.0))
            v2 = (v2 - 2 * (x.r_pu * p + x.x_pu * q)) / (x.ratio_pu or 1) ** 2
        assert v == pytest.approx(v2, abs=1e-12)


def test_ranges_give_what_the_sweep_gives(trees):
    branch, bus, nodal, tree = trees
    heavy = nodal.withColumn("p_pu", F.when(F.col("n") == 2, F.col("p_pu") / 20).otherwise(F.col("p_pu")))
    swept, ranged = (flow.power_flow(tree, branch, bus, heavy, most_branches=m, width=9) for m in (200_000, 0))
    for a, b, key in zip(swept[:2], ranged[:2], ("branch_id", "bus_id"), strict=True):
        x, y = ({(r.n, r.oe, r[key]): r for r in df.collect()} for df in (a, b))
        assert x.keys() == y.keys() and len(x) == 2 * branch.count()
        for k, r in x.items():
            for c in set(a.columns) - {*KEYS, key}:
                assert r[c] == pytest.approx(y[k][c], abs=1e-10)
    for x, y in zip(*(sorted(df.collect(), key=str) for df in (swept[2], ranged[2])), strict=True):
        assert (x.n, x.oe, x.converged) == (y.n, y.oe, y.converged) and x.converged and abs(x.passes - y.passes) <= 1


def test_two_infeeders(spark):
    branch = spark.createDataFrame([(0, "u", "f", "a", 0.1, 0.0, None), (0, "w", "g", "b", 0.1, 0.0, None)], "n int, branch_id string, from_bus string, to_bus string, r_pu double, x_pu double, ratio_pu double")
    bus = spark.createDataFrame([(0, "f", 1.0), (0, "g", 1.05), (0, "a", None), (0, "b", None)], "n int, bus_id string, v_set_pu double").withColumns({"v_min_pu": F.lit(0.9), "v_max_pu": F.lit(1.1)})
    nodal = spark.createDataFrame([(0, "oel", "a", 0.01), (0, "oel", "b", 0.01)], "n int, oe string, bus_id string, p_pu double").withColumns({"q_pu": F.lit(0.0), "t": F.lit("2026-01-01").cast("timestamp_ntz")})
    for most in (200_000, 0):
        _, v, done = flow.power_flow(None, branch, bus, nodal, most_branches=most)
        got = {r.bus_id: r.v2_pu for r in v.collect()}
        assert got == {"a": pytest.approx(0.997999, abs=1e-5), "b": pytest.approx(1.1005, abs=1e-5)} and done.head().converged
    load = spark.createDataFrame([(0, "1", "a"), (0, "2", "b")], "n int, load_id string, bus_id string")
    readings = spark.createDataFrame([("1", 0.0, 0.0), ("2", 0.0, 0.0)], "load_id string, real_power_w double, reactive_power_var double").withColumn("t", F.lit("2026-01-01").cast("timestamp_ntz"))
    row = envelope.envelope_linear(network.tree_labels(branch), branch, bus, load, readings, load.select("n", "load_id"), cap_kw=1e6).head()
    # import by the lower infeeder's headroom, export by the higher one's
    assert row.lb_kw == pytest.approx(-(1 - 0.81) / (2 * 0.1 / 1e3)) and row.ub_kw == pytest.approx((1.21 - 1.1025) / (2 * 0.1 / 1e3))


def test_unsound_trees_are_refused(spark):
    kind = "n int, branch_id string, from_bus string, to_bus string"
    with pytest.raises(ValueError, match="cycle"):
        network.tree_labels(spark.createDataFrame([(0, "x", "a", "b"), (0, "y", "b", "a"), (1, "z", "r", "a")], kind))
    with pytest.raises(ValueError, match="several branches"):
        network.tree_labels(spark.createDataFrame([(0, "x", "a", "c"), (0, "y", "b", "c")], kind))
    assert network.tree_labels(spark.createDataFrame([], kind)).count() == 0


def test_running_sums_over_ranges(spark):
    rng = random.Random(3)
    rows = [(k % 2, rng.randrange(30), f"i{k}", rng.uniform(-1, 1)) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, a int, b string, x double")
    for parts in (1, 5):
        out = sums_before(dealt_in_order(df, ["g"], ["a", "b"], parts), ["g"], "_part", ["a", "b"], {"before": "x"}).collect()
        assert len(out) == len(rows) and len({r._part for r in out}) >= min(parts, 2)
        for g in (0, 1):
            total = 0.0
            for r in sorted((r for r in out if r.g == g), key=lambda r: (r.a, r.b)):
                assert r.before == pytest.approx(total, abs=1e-12)
                total += r.x
