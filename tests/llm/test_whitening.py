"""Whitening: factors and rotations against a plain eigenvalue solver, exact sums, edges, and the query."""

import math
import os
from decimal import Decimal
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from feederflow.llm import whitening as w

DIR = "/root/testdata/sf0.001"


def exact(vectors):
    """(n, sums, covariance as fractions) of whole-numbered steps."""
    x = [[math.floor(64 * float(c)) + w.SHIFT for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = [[n * a - b for a, b in zip(r, s, strict=True)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(len(s))] for i in range(len(s))]
    return x, n, s, cov


def holds(got, vectors, ids, most=32):
    """Rows (id, component, n, deviation, whitened, explained, identity_error) against a plain solver."""
    x, n, s, cov = exact(vectors)
    v = np.array([[float(c) for c in r] for r in cov])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    rank = int((values > 1e-9 * values.max()).sum())
    by = {(r[0], r[1]): r for r in got}
    assert len(got) == len(ids) * min(most, rank)
    sign = {}
    for k in range(min(most, rank)):
        for i, own in zip(ids, x, strict=True):
            r = by[i, k + 1]
            centred = [n * a - b for a, b in zip(own, s, strict=True)]
            assert r[2] == n and int(r[3]) == sum(c * c for c in centred)
            want = float(np.dot(np.array(centred, float) / n, axes[:, k])) / math.sqrt(values[k])
            if abs(want) > 1e-3:
                sign.setdefault(k, math.copysign(1, want * r[4]))
            assert abs(r[4] - sign.get(k, 1) * want) < 1e-6 * (1 + abs(want)) or abs(want) <= 1e-3
            assert math.isclose(r[5], values[k] / np.trace(v), rel_tol=1e-6) and r[6] < 1e-4


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for m, rank in ((1, 1), (2, 2), (7, 7), (8, 3), (33, 33), (40, 12)):
        base = rng.normal(size=(m, rank)) * 10.0 ** rng.integers(-3, 3, rank)
        a = (base @ base.T).astype(np.longdouble)
        factor, order = w.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(np.triu(factor, 1), 0)
        assert np.allclose((factor @ factor.T).astype(float), a[np.ix_(order, order)].astype(float), rtol=1e-9, atol=1e-9 * float(a.max()))
        turned = w.jacobi(factor)
        gram = (turned.T @ turned).astype(float)
        want = np.linalg.eigvalsh(a.astype(float))[::-1][:rank]
        assert np.allclose(gram.diagonal(), want, rtol=1e-6) and np.all(np.diff(gram.diagonal()) <= 0)
        assert np.abs(gram - np.diag(gram.diagonal())).max() <= 1e-15 * gram.max()


def test_products_of_large_numbers():
    rng = np.random.default_rng(2)
    for top in (5, 1 << 21, (1 << 42) - 1):
        x = rng.integers(-top, top + 1, (300, 3))
        o = x.astype(object)
        assert (w.products(x) == o.T @ o).all()


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, vector int, deviation string")


def long_rows(df, **kw):
    out = w.by_component(*w.whiten(df, **kw), df)
    return [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out.collect()]


def test_edges(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(60, 4))]
    bad = [None, [None, 1.0, 2.0, 3.0], [math.nan, 1.0, 2.0, 3.0], [math.inf, 0.0, 0.0, 0.0], [1.0, 2.0], [], [1e30, 0.0, 0.0, 0.0]]
    rows = [(i, v, 1, "x") for i, v in enumerate(good)] + [(None if i == 0 else 100 + i, v, 1, "x") for i, v in enumerate(bad)] + [(7, good[7], 1, "x"), (None, good[0], 1, "x")]
    vectors, ids = [*good, good[7], good[0]], [*range(60), 7, None]
    holds_any = long_rows(frame(spark, rows))
    assert len(holds_any) == 62 * 4 and {r[0] for r in holds_any} == set(ids)
    x, n, s, _ = exact(vectors)
    want = {(i, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))) for i, v in zip(ids, x, strict=True)}
    assert {(r[0], int(r[3])) for r in holds_any} == want
    assert max(r[6] for r in holds_any) < 1e-4


def test_without_components(spark):
    assert long_rows(frame(spark, [(1, [1.0, 2.0], 1, "x"), (2, [1.0, 2.0], 1, "x")])) == []
    assert long_rows(frame(spark, [(1, None, 1, "x")])) == []
    assert long_rows(frame(spark, [(1, [1.0], 1, "x")]).limit(0)) == []


def test_rank_below_width_and_few_components(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-500, 500, (80, 3)) / 64
    vectors = [[*map(float, r), float(r[0] + r[1]), 2.5] for r in a]
    got = long_rows(frame(spark, [(i, v, 1, "x") for i, v in enumerate(vectors)], "array<double>"))
    holds(got, vectors, list(range(80)))
    assert max(r[1] for r in got) == 3
    holds(long_rows(frame(spark, [(i, v, 1, "x") for i, v in enumerate(vectors)], "array<double>"), most=2), vectors, list(range(80)), 2)


def test_far_values_and_partitions(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(50, 3)) * [1e6, 1e3, 1] + [3e9, -2e8, 5]]
    df = frame(spark, [(i, v, 1, "x") for i, v in enumerate(vectors)], "array<double>")
    got = long_rows(df.repartition(7))
    x, n, s, _ = exact(vectors)
    assert {(r[0], r[3]) for r in got} == {(i, Decimal(sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)))) for i, v in enumerate(x)}
    assert max(r[6] for r in got) < 1e-4
    one = {(r[0], r[1]): r[4] for r in long_rows(df.coalesce(1))}
    assert all(abs(one[r[0], r[1]] - r[4]) < 1e-9 for r in got)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet'").fetchall()
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    got = [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in entry.queries()["op12_whitening"](spark, DIR).collect()]
    holds(got, [v for _, v in rows], [i for i, _ in rows])
