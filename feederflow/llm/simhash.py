"""SimHash fingerprints, and all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederflow.llm.shared import Words, mix, shingles, slices, stored, texts

WORDS = 2  # of 64 bits each in a fingerprint


def fingerprints(batch: pa.Array, width: int = 2) -> np.ndarray:
    """(texts, WORDS) unsigned 64-bit words.

    Terms are the windows of ``width`` words, A-Z lower-cased, and weigh as often as they occur;
    single words weigh a quarter of that, so that texts of a few words have terms in common
    too. Each term votes with its weight for or against every bit. No terms: all bits 0.
    """
    words = Words(batch, lower=True)
    n = len(words.offsets) - 1
    votes = np.zeros((n, 64 * WORDS), np.int64)
    windows, bounds = shingles(words, width)
    for h, edges, weight in ((windows, bounds, 4), (words.hashes(), words.offsets, 1)):
        # a piece's bits stay in the processor's cache
        step = 1 << 11
        for at in range(0, len(h), step):
            part = h[at : at + step]
            wide = np.stack([mix(part + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k in range(WORDS)], 1)
            bits = np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1)
            first = int(np.searchsorted(edges, at, side="right")) - 1
            last = int(np.searchsorted(edges, at + len(part), side="left"))
            docs = np.arange(first, last)
            low, high = np.maximum(edges[docs], at) - at, np.minimum(edges[docs + 1], at + len(part)) - at
            docs, low, high = docs[high > low], low[high > low], high[high > low]
            runs = np.add.reduceat(bits, low, axis=0, dtype=np.int32)
            votes[docs] += weight * (2 * runs.astype(np.int64) - (high - low)[:, None])
    return np.packbits(votes > 0, axis=1).view(">u8").astype(np.uint64)


def hexed(words: np.ndarray) -> list[str]:
    return [("%016x" * WORDS) % tuple(w) for w in words.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(1) / (64.0 * WORDS)


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of a part that also wait for, or serve, a neighbouring part.
INNER, LAST, HEAD = 0, 1, 2


def paired(docs: list[int | None], own: list[str], after: list[str]) -> pa.RecordBatch:
    """The ``PAIRED`` columns of texts and the texts that follow them."""
    cut = [len(x) - len(x) // 4 for x in own]
    changed = [x[:k] + y[: len(x) - k] for x, y, k in zip(own, after, cut, strict=True)]
    # in order, a text's follower is the next text
    chain = all(x is y for x, y in zip(own[1:], after[:-1], strict=True))
    prints = fingerprints(pa.array([*own, after[-1]] if chain else own + after, pa.string()))
    ours, theirs = prints[: len(own)], prints[1:] if chain else prints[len(own) :]
    other = fingerprints(pa.array(changed, pa.string()))
    fields = [pa.array(docs, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array(hexed(ours)), pa.array(hexed(other)), pa.array(likeness(ours, other)), pa.array(likeness(ours, theirs))]
    return pa.RecordBatch.from_arrays(fields, [f.split()[0] for f in PAIRED.split(", ")])


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 10_000, part_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next text.

    The edited text has its last quarter (floor) of code points replaced by as many from the start
    of the next document (by ascending id; after the last comes the first), or all of them if it
    has fewer. Documents are sorted by ranges of their id, of about ``rows_per_part`` rows or
    ``part_bytes`` bytes, so texts move once. A range's last document meets the first of the next
    range in a join over these two texts a range. Returns (id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``).

    Null text is empty; null ids come first; rows with equal ids follow each other as the table
    has them, and get a row each. Other columns are not read. An empty table gives an empty table.
    """
    rows = texts(df, id_col, text_col)
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).head()
    parts = max(1, -(-n // rows_per_part), -(-(size or 0) // part_bytes))
    # the row's place in the table parts even an id that a third of all rows have
    ordered = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), None
        docs: list[int | None] = []
        held: list[str] = []

        def edge(kind: int, doc: int | None, text: str) -> pa.RecordBatch:
            columns = [pa.array([doc], pa.int64()), *(pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text], pa.string())], names)

        names = [f.split()[0] for f in f"{PAIRED}, part int, edge int, edge_text string".split(", ")]
        for batch in (x for whole in batches for x in slices(whole, rows=1_000)):
            docs += batch.column("doc_id").to_pylist()
            held += batch.column("text").to_pylist()
            if first is None:
                first = held[0]
                yield edge(HEAD, docs[0], first)
            if len(held) > 1:
                got = paired(docs[:-1], held[:-1], held[1:])
                k = got.num_rows
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array([part] * k, pa.int32()), pa.array([INNER] * k, pa.int32()), pa.nulls(k, pa.string())], names)
                docs, held = docs[-1:], held[-1:]
        if held:
            yield edge(LAST, docs[0], held[0])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield paired(*(c.to_pylist() for c in batch.columns))

    made = stored(dealt.select("doc_id", "text").mapInArrow(run, f"{PAIRED}, part int, edge int, edge_text string"), "simhash-pairs")
    heads = made.where(F.col("edge") == HEAD).select("part", "edge_text")
    # one number for each part
    order = Window.orderBy("part")
    nexts = heads.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next"))
    lasts = made.where(F.col("edge") == LAST).select("part", "doc_id", F.col("edge_text").alias("text")).join(nexts, "part")
    ends = lasts.join(heads.select(F.col("part").alias("next"), F.col("edge_text").alias("after")), "next").select("doc_id", "text", "after").mapInArrow(meet, PAIRED)
    inner = made.where(F.col("edge") == INNER).select(*ends.columns)
    return inner.unionByName(ends).withColumnRenamed("doc_id", id_col)


def halves(fingerprint: Column) -> list[Column]:
    return [F.conv(F.substring(fingerprint, 16 * k + 1, 16), 16, -10).cast("long") for k in range(WORDS)]


#: Distinct fingerprints from which on four wide blocks cost less than eight: what a block lets through grows with
#: the table, 1 of 2**16 or 1 of 2**32, while the blocks looked up (136 or 21,956 for 15 bits) do not.
MANY = 10_000_000


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 15, blocks: int | None = None) -> DataFrame:
    """All (query, fingerprint, distance) of distinct fingerprints at most ``radius`` bits apart, equal ones too.

    Both sides have a column ``fingerprint``. Its bits are cut into ``blocks`` blocks; table k puts
    block k in front. Two fingerprints within the radius have a block with at most radius // blocks
    different bits, so looking up each query's blocks with up to so many bits flipped finds every
    such pair; the first table that holds a pair reports it. Every number of blocks gives the same pairs;
    None takes four or eight by the number of distinct fingerprints. Nulls match nothing, empty tables give none.
    """
    if blocks is None:
        blocks = 4 if fingerprints.select("fingerprint").distinct().count() > MANY else 8
    if blocks not in (4, 8, 16, 32) or radius < 0:
        raise ValueError("blocks: 4, 8, 16 or 32; radius: 0 or more")
    width, flips = 64 * WORDS // blocks, radius // blocks
    masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(width), n)]
    longs = lambda values: F.lit(values).cast("array<bigint>")

    def cut(words: list[Column]) -> list[Column]:
        out = [F.shiftrightunsigned(w, 64 - width * (k + 1)) for w in words for k in range(64 // width)]
        return [b.bitwiseAND(F.lit((1 << width) - 1).cast("long")) for b in out]

    def tables(df: DataFrame, name: str, masks: list[int]) -> DataFrame:
        one = df.select("fingerprint").where("fingerprint is not null").distinct().select(*[h.alias(f"h{k}") for k, h in enumerate(halves(F.col("fingerprint")))])
        entries = [_probes(k, block, longs(masks)) for k, block in enumerate(cut([F.col(f"h{k}") for k in range(WORDS)]))]
        return one.withColumn("entry", F.explode(F.concat(*entries))).select(*[f"h{k}" for k in range(WORDS)], "entry.*").alias(name)

    q, f = tables(queries, "q", masks), tables(fingerprints, "f", [0])
    apart = [F.col(f"q.h{k}").bitwiseXOR(F.col(f"f.h{k}")) for k in range(WORDS)]
    distance = sum((F.bit_count(x) for x in apart), F.lit(0))
    met = (F.col("q.table") == F.col("f.table")) & (F.col("q.block") == F.col("f.block")) & (distance <= radius)
    for k, x in enumerate(cut(apart)[:-1]):
        met = met & ((F.col("q.table") <= k) | (F.bit_count(x) > flips))
    text = lambda side: F.concat(*[F.lower(F.lpad(F.hex(f"{side}.h{k}"), 16, "0")) for k in range(WORDS)])
    # a fingerprint is many rows here, which Spark's sizes don't count: neither side is small enough to be broadcast
    return q.hint("merge").join(f.hint("merge"), met).select(text("q").alias("query"), text("f").alias("fingerprint"), distance.alias("distance"))


def _probes(k: int, block: Column, masks: Column) -> Column:
    return F.transform(masks, lambda m: F.struct(F.lit(k).alias("table"), block.bitwiseXOR(m).alias("block")))


def asked_of(docs: DataFrame, every: int) -> Column:
    return F.coalesce(docs["doc_id"] % every == 0, F.lit(False))


def near_links(docs: DataFrame, radius: int = 15, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Links (``doc_id``, ``fingerprint``, ``distance``) of the rows whose id ``every`` divides, and members (``fingerprint``, ``doc_id``).

    A link leads to a class, all documents with a fingerprint; each asked row has one to its own
    class, at distance 0, in which the other members are its nearest texts.
    """
    asked = docs.where(asked_of(docs, every)).select("doc_id", F.col("fingerprint").alias("query"))
    found = within_radius(asked.withColumnRenamed("query", "fingerprint"), docs, radius)
    return asked.join(found, "query").select("doc_id", "fingerprint", "distance"), docs.select("fingerprint", "doc_id")


def count_near(docs: DataFrame, radius: int = 15, every: int = 20, close: int = 3) -> DataFrame:
    """Adds ``n_near`` and ``n_links`` for rows whose id ``every`` divides (else null).

    ``n_links`` is the number of other documents within ``radius``, those with an equal
    fingerprint too, by the classes that ``near_links`` leads to; ``n_near`` that of distinct other
    fingerprints within ``close``. Of words replaced in a text of 200 to 400 words, 15 bits hold
    nearly all fingerprints of one or two and 9 in 10 of five. ``docs`` has (doc_id, fingerprint)
    and more columns, and is read several times.
    """
    if close > radius:
        raise ValueError("close: at most radius")
    is_asked = asked_of(docs, every)
    asked = docs.where(is_asked)
    sizes = docs.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("size"))
    # the links of equal rows are equal, so they are counted by class
    found = within_radius(asked, docs, radius).join(sizes, "fingerprint").groupBy("query")
    found = found.agg(F.count(F.when((F.col("distance") > 0) & (F.col("distance") <= close), 1)).alias("_near"), (F.sum("size") - 1).alias("_links"))
    # rows that are not asked take no part in the join, where their null keys would meet in one task
    none = F.lit(0).cast("long")
    counted = asked.join(found, asked["fingerprint"] == found["query"], "left").select(*[asked[c] for c in docs.columns], F.coalesce("_near", none).alias("n_near"), F.coalesce("_links", none).alias("n_links"))
    null = F.lit(None).cast("long")
    return counted.unionByName(docs.where(~is_asked).withColumns({"n_near": null, "n_links": null}))
