"""Line deduplication: two Bloom filters find suspected repeats, and only those are shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.shared import SPACE, fresh, renamed, stored, texts

_STRIP = SPACE.encode()
#: Slots of a filter that travel as one row, and probes of a key.
SEGMENT, PROBES = 1 << 20, 2
#: Parts that the marks of one line are dealt to where they are joined.
SALTS = 16


def _key(line: bytes, least: int) -> bytes | None:
    """The line's key if it has ``least`` code points or more; the line is lower-cased already."""
    key = line.strip(_STRIP)
    n = len(key)
    if n < least or (n < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def _keys(text: str, least: int) -> set[bytes]:
    # bytes.lower() changes A-Z alone
    found = {_key(x, least) for x in text.encode().lower().split(b"\n")}
    found.discard(None)
    return found


def _slots(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(PROBES)]


def _has(seen: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([seen[s] for s in slots])


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def repeat_filter(rows: DataFrame, min_chars: int, max_slots: int) -> tuple[np.ndarray, int]:
    """The packed twice-seen filter over the keys of all documents, and its slots.

    Each task keeps a once-seen and a twice-seen filter and emits their filled segments. Two
    once-seen filters that share a key's slots make it twice seen, so no repeat is missed. The
    filters have 16 slots a line up to ``max_slots``, which bounds what is merged and broadcast;
    beyond it more lines are suspected and shuffled, and the result is the same.
    """
    spark = rows.sparkSession
    lines = rows.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).head()[0] or 1
    size = min(max_slots, max(SEGMENT, 1 << int(16 * lines - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for batch in batches:
            h = _hashes([k for t in batch.column("text").to_pylist() for k in _keys(t, min_chars)])
            h, n = np.unique(h, return_counts=True)
            slots = _slots(h, size)
            again = (n > 1) | _has(once, slots)
            for s in slots:
                twice[s[again]] = True
                once[s] = True
        for k in range(size // SEGMENT):
            part = slice(k * SEGMENT, (k + 1) * SEGMENT)
            if once[part].any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32())} | {n: [zlib.compress(np.packbits(x[part]), 1)] for n, x in (("once", once), ("twice", twice))})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for frame in frames:
            for k, a, b in zip(frame["segment"], frame["once"], frame["twice"], strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if k not in held:
                    held[k] = [a.copy(), b.copy()]
                else:
                    held[k][1] |= b | (held[k][0] & a)
                    held[k][0] |= a
        for k, (_, b) in held.items():
            yield pd.DataFrame({"segment": [k], "twice": [zlib.compress(b, 1)]})

    parts = rows.select("text").mapInArrow(fill, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").mapInPandas(merge, "segment int, twice binary")
    out = np.zeros(size // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most max_slots / 8 bytes in all
        out[row.segment * (SEGMENT // 8) : (row.segment + 1) * (SEGMENT // 8)] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return out, size


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, keep: str = "max", max_slots: int = 1 << 26, max_keys: int = 1 << 18) -> DataFrame:
    r"""Drop lines that many documents share, but for one document each.

    A line's key is the line stripped of blanks and tab to carriage return, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_docs`` documents or more hold keep
    their lines only in the holder with the largest (``keep="max"``) or smallest
    (``"min"``) id. Adds ``n_lines``, ``n_dropped`` (long) and ``kept_text``.

    Suspected lines alone are shuffled. Up to ``max_keys`` confirmed keys (24 bytes each) are sent to all tasks, which
    cut their own rows in place; beyond that each document meets the marks of its lines in a join.

    Null or empty text: one empty line. A null id: the row stays as it is and does not count.
    Repeated rows of an id are one document, and all of them get the same lines dropped. Columns
    named like the added ones are replaced. An empty table gives an empty table.
    """
    df = renamed(df, ["n_lines", "n_dropped", "kept_text"])
    rows = texts(df, id_col, text_col).where("doc_id is not null")
    spark = df.sparkSession
    packed, size = repeat_filter(rows, min_chars, max_slots)
    shared = spark.sparkContext.broadcast((packed, size))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, size = shared.value
        seen = np.unpackbits(packed).view(bool)
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = _keys(text, min_chars)
                ids += [doc] * len(own)
                keys += own
            at = np.flatnonzero(_has(seen, _slots(_hashes(keys), size)))
            found = [keys[i] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array(found, pa.binary()), pa.array([xxhash.xxh3_128_digest(k) for k in found], pa.binary())], ["doc_id", "key", "mark"])

    held = stored(rows.mapInArrow(suspects, "doc_id long, key binary, mark binary"), "line-suspects")
    pick = F.max if keep == "max" else F.min
    # the keys themselves confirm; equal marks of different keys are not to be expected in 2**64 keys
    confirmed = held.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), pick("doc_id").alias("keeper"), F.first("mark").alias("mark")).where(F.col("n_docs") >= min_docs)
    confirmed = stored(confirmed.select("mark", "keeper"), "line-confirmed")
    text, doc = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    if confirmed.count() <= max_keys:
        found = confirmed.toArrow()
        keepers = spark.sparkContext.broadcast(dict(zip(found["mark"].to_pylist(), found["keeper"].to_pylist(), strict=True)))
        added = F.arrow_udf(_without_kept(min_chars, keepers), ADDED)
        joined, cut = df, added(text, doc)
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        marked = held.select("doc_id", "mark", salt.alias("salt"))
        every = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        key, marks = fresh(df, "key", "marks")
        gone = marked.join(every, ["mark", "salt"]).where("doc_id <> keeper").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("mark").alias(marks))
        joined = df.join(gone, doc == F.col(key), "left")
        cut = F.arrow_udf(_without_marks(min_chars), ADDED)(text, F.col(marks))
    (one,) = fresh(joined, "cut")
    return joined.withColumn(one, cut).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(one)[c].alias(c) for c in ("n_lines", "n_dropped", "kept_text")])


ADDED = "n_lines long, n_dropped long, kept_text string"


def _cut(text: pa.Array, min_chars: int, dropped) -> pa.Array:
    """The texts without the lines whose marks ``dropped(row, mark)`` tells to drop."""
    n_lines, n_dropped, kept = [], [], []
    for row, t in enumerate(text.to_pylist()):
        lines = t.split("\n")
        keys = [_key(x, min_chars) for x in t.encode().lower().split(b"\n")]
        stay = [x for x, k in zip(lines, keys, strict=True) if k is None or not dropped(row, xxhash.xxh3_128_digest(k))]
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
        kept.append(t if len(stay) == len(lines) else "\n".join(stay))
    return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["n_lines", "n_dropped", "kept_text"])


def _without_kept(min_chars: int, keepers):
    def cut(text: pa.Array, doc: pa.Array) -> pa.Array:
        own, of = doc.to_pylist(), keepers.value.get
        # a row without an id keeps its lines
        return _cut(text, min_chars, lambda row, mark: own[row] is not None and of(mark, own[row]) != own[row])

    return cut


def _without_marks(min_chars: int):
    def cut(text: pa.Array, marks: pa.Array) -> pa.Array:
        gone = [frozenset(x or ()) for x in marks.to_pylist()]
        return _cut(text, min_chars, lambda row, mark: mark in gone[row])

    return cut
