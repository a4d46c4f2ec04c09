"""Whitening of embeddings: exact scatter in Spark, pivoted Cholesky and one-sided Jacobi of its factor on the driver.

Entries are steps of 1/64, ``floor(64 c)``, so that counts, sums and products are whole numbers and do not
depend on how rows are dealt to tasks. Only square tables of the vectors' width reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.shared import fresh

#: Steps of a unit, what is added to them, and the first count of steps that is no longer taken.
STEPS, SHIFT, MOST = 64, 1_000_000, 1 << 41
#: A step count is two limbs of so many bits; sums of their products over this many rows are exact in doubles.
LIMB, ROWS = 21, 2048


def steps(vectors: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """({width: places of its vectors}, {width: their steps}) as one table a width, of the vectors without null, infinite or too large entries."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    widths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    flat = vectors.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    begins = np.concatenate(([0], np.cumsum(widths)))
    found = {}
    for width in np.unique(widths[widths > 0]):
        own = np.flatnonzero(widths == width)
        x = np.floor(STEPS * values[begins[own][:, None] + np.arange(width)])
        sound = (np.abs(x) < MOST).all(1)
        found[int(width)] = (own[sound], x[sound].astype(np.int64))
    return found


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows whose vectors count, some at a time, and the vectors' steps."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            places, x = steps(part.column("vector")).get(width, (np.zeros(0, np.int64), None))
            if len(places):
                yield part.take(pa.array(places)), x


def _emitted(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of tables of whole numbers, each as two longs."""
    for part, table in tables.items():
        longs = [pa.array((x.astype(np.int64)).tolist(), pa.list_(pa.int64())) for x in (table >> _BITS, table & ((1 << _BITS) - 1))]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(table), pa.int32()), pa.array(range(len(table)), pa.int32()), *longs], ["part", "row", "high", "low"])


#: Bits of the lower long of a whole number, and the columns of rows of whole numbers.
_BITS = 62
_PARTS = "part int, row int, high array<long>, low array<long>"


def _summed(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """{(table, row): sums} of rows of whole numbers, those of a table's row met in one task."""
    whole = lambda high, low: (np.asarray(high).astype(object) << _BITS) + np.asarray(low).astype(object)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            for p, r, high, low in zip(frame["part"], frame["row"], frame["high"], frame["low"], strict=True):
                own = whole(high, low)
                held[p, r] = held[p, r] + own if (p, r) in held else own
        for (p, r), own in held.items():
            yield pd.DataFrame({"part": [p], "row": [r], "high": [(own >> _BITS).astype(np.int64)], "low": [(own & ((1 << _BITS) - 1)).astype(np.int64)]})

    merged = parts.repartition("part", "row").mapInPandas(merge, _PARTS)
    return {(r.part, r.row): whole(r.high, r.low) for r in merged.toLocalIterator()}


def sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(vectors, sums of their steps) of the width that most vectors have; of equally many the largest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, (places, x) in steps(batch.column("vector")).items():
                if len(places):
                    # sums of a batch stay far within a long
                    own = np.append(x.sum(0), len(places)).astype(object)[None]
                    held[width] = held[width] + own if width in held else own
        yield from _emitted(held)

    found = {p: v for (p, _), v in _summed(rows.select("vector").mapInArrow(count, _PARTS)).items()}
    if not found:
        return 0, np.zeros(0, object)
    best = max(found, key=lambda w: (found[w][-1], w))
    return int(found[best][-1]), found[best][:-1]


def products(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers below 2**42, at most ``ROWS`` rows, without rounding."""
    if len(x) == 0 or int(np.abs(x).max()) < 1 << LIMB:
        d = x.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    high = x >> LIMB
    low = (x - (high << LIMB)).astype(np.float64)
    high = high.astype(np.float64)
    cross = (high.T @ low).astype(np.int64).astype(object)
    return ((high.T @ high).astype(np.int64).astype(object) << (2 * LIMB)) + ((cross + cross.T) << LIMB) + (low.T @ low).astype(np.int64).astype(object)


def scatter(rows: DataFrame, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole-numbered centre, n times the scatter about the mean), both exact.

    Vectors are centred at the whole number nearest to the mean before they are multiplied; what lacks to the mean
    is corrected with whole numbers.
    """
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in total], np.int64)
    width = len(centre)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, x in _batches(batches, width):
            own = products(x - centre)
            held = own if held is None else held + own
        if held is not None:
            yield from _emitted({0: held})

    found = _summed(rows.select("vector").mapInArrow(gather, _PARTS))
    table = np.stack([found[0, k] for k in range(width)])
    off = total - n * centre.astype(object)
    return centre, n * table - np.outer(off, off)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower factor, order) with a[order][:, order] = factor factor'; columns end where rounding begins."""
    a, m = a.copy(), len(a)
    order, factor = np.arange(m), np.zeros((m, m), a.dtype)
    left = a.diagonal().copy()
    least = m * np.finfo(np.float64).eps * left.max(initial=0)
    for k in range(m):
        p = k + int(left[k:].argmax())
        if not left[p] > least:
            return factor[:, :k], order
        if p != k:
            for x in (order, left, factor):
                x[[k, p]] = x[[p, k]]
            a[[k, p]] = a[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
        root = np.sqrt(left[k])
        factor[k, k] = root
        factor[k + 1 :, k] = (a[k + 1 :, k] - (factor[k + 1 :, :k] * factor[k, :k]).sum(1)) / root
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor's columns, rotated in pairs until all are at right angles, largest first.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that are rotated together.
    """
    g = np.array(factor, order="F")
    r = g.shape[1]
    ring = list(range(r + r % 2))
    tiny = 4 * np.finfo(g.dtype).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = np.array([sorted(p) for p in zip(ring[:half], ring[:half - 1:-1], strict=True) if max(p) < r], int).reshape(-1, 2)
            ring = [ring[0], ring[-1], *ring[1:-1]]
            x, y = g[:, pairs[:, 0]], g[:, pairs[:, 1]]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(c) > tiny * np.sqrt(a * b)
            if not off.any():
                continue
            turned = True
            z = np.where(off, (b - a) / np.where(off, 2 * c, 1), 0)
            t = np.where(off, np.where(z >= 0, 1, -1) / (np.abs(z) + np.sqrt(1 + z * z)), 0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            g[:, pairs[:, 0]], g[:, pairs[:, 1]] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    return g[:, np.argsort(-(g * g).sum(0), kind="stable")]


@dataclass(frozen=True)
class Whitening:
    """``values`` and ``vectors`` (a column each) of the largest components, of ``n`` vectors with whole ``centre`` and ``off`` = sums less n centres."""

    n: int
    centre: np.ndarray
    off: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sums of steps x, exact."""
        y = x - self.centre
        if len(y) and self.n * (int(np.abs(y).max()) + 1) >= 1 << 62:
            y = y.astype(object)
        return y * self.n - (self.off if y.dtype == object else self.off.astype(np.int64))

    def projected(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))


def components(n: int, centre: np.ndarray, total: np.ndarray, table: np.ndarray, most: int) -> Whitening:
    """From exact sums and n times the scatter; in extended precision where the machine has it, rounded to doubles last."""
    exact = lambda x: np.array([np.longdouble(str(v)) for v in x.ravel()], np.longdouble).reshape(x.shape)
    v = exact(table) / np.longdouble(n) / np.longdouble(n)
    factor, order = pivoted_cholesky(v)
    turned = jacobi(factor)
    values = (turned * turned).sum(0)
    vectors = np.zeros((len(v), turned.shape[1]), np.longdouble)
    vectors[order] = turned / np.sqrt(values)
    share = values / v.diagonal().sum() if len(values) else values
    own = lambda x: x[..., :most].astype(np.float64)
    return Whitening(n, centre, total - n * centre.astype(object), own(values), own(vectors), own(share))


def fit(rows: DataFrame, most: int) -> Whitening | None:
    """The components of all vectors of ``rows`` (vector array<double>), or None without a vector that counts."""
    n, total = sums(rows)
    if not n:
        return None
    centre, table = scatter(rows, n, total)
    return components(n, centre, total, table, most)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity.

    Parts are centred at their own means before they are multiplied, and joined by the means' distance.
    """
    width = len(model.centre)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for _, x in _batches(batches, width):
            z = model.projected(model.deviations(x))
            own = _joined(None, (len(z), z.mean(0), (z - z.mean(0)).T @ (z - z.mean(0))))
            held = _joined(held, own)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"n": [held[0]], "mean": [held[1].tolist()], "scatter": [held[2].ravel().tolist()]})

    if not len(model.values):
        return 0.0
    held = None
    # at most 32 x 32 numbers a task, met one by one
    for r in rows.select("vector").mapInArrow(gather, "n long, mean array<double>, scatter array<double>").toLocalIterator():
        held = _joined(held, (r.n, np.array(r["mean"]), np.array(r.scatter).reshape(len(r["mean"]), -1)))
    return float(np.abs(held[2] / held[0] - np.eye(len(held[1]))).max(initial=0))


def _joined(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> tuple[DataFrame, Whitening | None]:
    """(id, ``deviation`` decimal, ``whitened`` array<double>) of each vector that counts, and the fitted components.

    Components are numbered by falling eigenvalue, at most ``most`` of them and none beyond the vectors' rank; ``whitened``
    holds the vector's projections on them, each divided by the root of its eigenvalue. ``deviation`` is the
    summed square of n times the steps less their sums, exact up to 38 digits.

    Left out: null vectors, vectors with null or non-finite entries, or entries of 2**35 or more (they have no
    step count that is multiplied exactly), empty ones, and those of another width than most (of
    equally many widths the largest counts). Null ids stay null; repeated rows count and come back as
    often as they are there; vectors that are all equal have no components and empty arrays. Other columns are not read. An
    empty table gives an empty table and None.
    """
    (own,) = fresh(df, "vector")
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias(own)).toDF("_id", "vector")
    kind = rows.schema["_id"].dataType.simpleString()
    model = fit(rows, most)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, len(model.centre)) if model else ():
            d = model.deviations(x)
            z = model.projected(d)
            if d.dtype != object and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
                d = d.astype(object)
            squares = [Decimal(int(v)) for v in (d * d).sum(1)]
            bounds = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(squares, pa.decimal128(38, 0)), pa.ListArray.from_arrays(bounds, pa.array(z.ravel()))], ["_id", "deviation", "whitened"])

    return rows.mapInArrow(project, f"_id {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("_id", id_col), model


def by_component(whitened: DataFrame, model: Whitening | None, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component, with the vectors' number, the component's share of the variance and the error of the identity."""
    vectors = rows.select(F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    error = identity_error(vectors, model) if model else 0.0
    share = F.array(*map(F.lit, map(float, model.explained))) if model is not None and len(model.explained) else F.array().cast("array<double>")
    long = whitened.select(id_col, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return long.select(id_col, (F.col("_k") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error"))
