"""Near-duplicates: one-permutation MinHash with optimal densification, bands, and star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.shared import Words, discard, mix, shingles, slices, stored, texts

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of the parity sketch of a set.
PARITY = 2048


def distinct_shingles(batch: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each lower-cased text, and their bounds."""
    h, bounds = shingles(Words(batch, lower=True), width)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    kept = np.bincount(owner[first], minlength=len(n)) if len(h) else np.zeros(len(n), np.int64)
    return h[first], np.concatenate(([0], np.cumsum(kept)))


def signatures(h: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation hashing: the least value of each bin; empty bins borrow from full ones.

    Densification is the optimal one: each empty bin asks bins in its own fixed pseudo-random
    order until it finds a full one, independently of the other empty bins.
    """
    n = len(bounds) - 1
    out = np.full((n, bins), _EMPTY)
    value = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    place = np.repeat(np.arange(n), np.diff(bounds)) * bins + (value >> np.uint64(40)) % np.uint64(bins)
    low = value & np.uint64((1 << 40) - 1)
    np.minimum.at(out.ravel(), place.astype(np.int64), low)
    full = out != _EMPTY
    rows, cols = np.nonzero(~full & full.any(1)[:, None])
    for attempt in range(1, 1 << 20):
        if not len(rows):
            break
        ask = (mix(cols.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = full[rows, ask]
        out[rows[found], cols[found]] = out[rows[found], ask[found]]
        rows, cols = rows[~found], cols[~found]
    return out


def parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Odd sketches as (texts, PARITY / 64) words: bit i says whether an odd number of shingles hash to i.

    Two sketches differ in at most as many bits as the sets have elements that they don't share.
    """
    n = len(bounds) - 1
    place = np.repeat(np.arange(n), np.diff(bounds)) * PARITY + (mix(h ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * PARITY) & 1).astype(bool)
    return np.packbits(odd).view(np.int64).reshape(n, PARITY // 64)


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=2_000):
                h, bounds = distinct_shingles(part.column("text"), width)
                signed = signatures(h, bounds, bands * rows).reshape(-1, bands, rows)
                keys = np.full(signed.shape[:2], 0, np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, r])
                n = np.diff(bounds)
                data = h.view(np.uint8)
                marks = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64))) for x in (keys, parities(h, bounds))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(marks, pa.binary()), *lists], ["doc_id", "n_shingles", "mark", "keys", "parity"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=2_000):
                h, bounds = distinct_shingles(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], ["doc_id", "items"])

    return run


def components(links: DataFrame, name: str, hot: int = 1_000) -> DataFrame:
    """The smallest id that each linked id reaches: ``(id, root)``, by alternating large and small stars.

    Every round is a few grouped minima over the links, and its result is written to the
    shared folder; the number of rounds grows with the logarithm of a component's size. Ids with
    at least ``hot`` links and a 1,000th of all (2,000 ids at most) get their minimum by broadcast,
    so that no id's links gather in one task.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())
    edges = stored(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), name)
    seen = mark(edges)
    while True:
        both = edges.union(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("c"))
        many = F.col("c") >= max(hot, seen[0] // 1_000)
        up = both.where("v > u").join(F.broadcast(least.where(many).select("u", F.col("m").alias("of_hot"))), "u", "left")
        # large star: larger neighbours of u hang on the least of u and all its neighbours
        large = up.where("of_hot is not null").selectExpr("v as u", "of_hot as v").union(up.where("of_hot is null").join(least.where(~many), "u").selectExpr("v as u", "m as v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(low, "u").selectExpr("explode(array(named_struct('u', u, 'v', m), named_struct('u', v, 'v', m))) as e").select("e.*").where("u <> v").distinct()
        after = stored(after, name)
        now = mark(after)
        if now == seen:
            return after.selectExpr("u as id", "v as root")
        discard(edges)
        edges, seen = after, now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """Components of documents whose sets of word shingles overlap by ``percent`` or more (Jaccard).

    Words ``[^ \\t-\\r]+`` of the text with A-Z lower-cased; a text of fewer than ``width`` words is
    one shingle. Returns per document (id, ``n_shingles``, ``component_id``: the smallest id
    reachable, ``kept``: whether it is its own).

    Documents with equal sets are one class; only classes take part. Signatures of
    ``bands * rows`` bins go into a bucket for each band (two sets at the threshold share none with
    probability (1 - 0.8**6)**42 = 3e-6). In a bucket every class is a candidate with the
    smallest id only: a star, not all pairs. Full sets confirm. Where a bucket then spans several
    components, the classes outside its largest are compared with those of the others, so no
    pair of a bucket that the star misses goes unseen unless it is linked already. Size and
    parity sketch, which bound the overlap from above, let hardly any unlinked pair out of that join.

    Empty or null texts have no shingles and are linked with nothing. A null id is in no
    component but its own and kept, with null ``component_id``. Repeated rows of an id get a row each, and
    are linked as one. Other columns are not read. An empty table gives an empty table.
    """
    given = texts(df, id_col, text_col)
    sketch = stored(given.mapInArrow(_sketch(width, bands, rows), "doc_id long, n_shingles long, mark binary, keys array<bigint>, parity array<bigint>"), "near-sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    # a class of equal sets goes by its smallest id
    classes = stored(full.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("parity").alias("parity")), "near-classes")
    in_band = classes.select("rep", "n", F.explode("keys").alias("key"))
    stars = in_band.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(in_band.join(stars, "key").select("key", "hub", "rep", "n"), "near-members")
    pairs = members.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    involved = members.select("rep").distinct()
    sets = stored(given.join(involved, given["doc_id"] == involved["rep"], "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(width), "doc_id long, items array<bigint>"), "near-sets")
    links = stored(confirmed(pairs, sets, percent), "near-links")
    roots = components(links, "near-stars")
    # buckets that still span several components: compare what the stars left out
    placed = members.join(roots, members["rep"] == roots["id"], "left").select("key", "hub", "rep", "n", F.coalesce("root", "rep").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("in_part"))
    largest = parts.groupBy("key").agg(F.max(F.struct("in_part", "root")).alias("top"), F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1")
    placed = placed.join(largest.select("key", F.col("top.root").alias("top")), "key")
    placed = stored(placed.join(classes.select("rep", "parity"), "rep"), "near-open")
    x, y = placed.where("root <> top").alias("x"), placed.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.rep") != F.col("x.hub")) & (F.col("y.rep") != F.col("y.hub")) & ((F.col("y.root") == F.col("y.top")) | (F.col("x.rep") < F.col("y.rep")))
    # sets at the threshold differ in (100 - percent) / (100 + percent) of their summed sizes at most, and no parity sketch in more
    bits = sum((F.bit_count(F.get("x.parity", F.lit(k)).bitwiseXOR(F.get("y.parity", F.lit(k)))) for k in range(PARITY // 64)), F.lit(0))
    alike = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * bits <= (100 - percent) * (F.col("x.n") + F.col("y.n")))
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & alike).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    extra = stored(confirmed(more, sets, percent), "near-more")
    if not extra.isEmpty():
        roots = components(links.union(extra), "near-stars")
    reps = classes.join(roots, classes["rep"] == roots["id"], "left").select("mark", F.coalesce("root", "rep").alias("root"))
    own = F.when(F.col("n_shingles") > 0, F.col("mark"))
    out = sketch.select("doc_id", "n_shingles", own.alias("mark")).join(reps, "mark", "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap by ``percent`` of their union or more."""
    left = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("of_b"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("of_a"))
    both = pairs.join(left, "b").join(right, "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")
