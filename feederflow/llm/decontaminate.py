r"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

Words are runs of letters A-Z (lower-cased), digits and all code points beyond ASCII,
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A window is ``size`` consecutive words of an item (a shorter item is one window),
and a set of shingles at their places. Shingles are ordered by how often documents hold them; a window needs
a document to hold one of its rarest few, so only these are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.llm.shared import mix, slices, stored

#: Parts that the places of one shingle are dealt to where they are joined.
SALTS = 16
#: Bits of a filter that are built together, and probes of a hash.
SEGMENT, PROBES = 1 << 16, 4
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Worded:
    """The words of texts: ``codes`` into ``vocabulary``, their ``hashes``, and ``offsets`` by text."""

    codes: np.ndarray
    vocabulary: pa.Array
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words(text: pa.Array) -> Worded:
    """Bytes are replaced one for one, so the texts keep their bounds."""
    text = pc.fill_null(text, "")
    text = text.cast(pa.string())
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = bytes(text.buffers()[2][bounds[0] : bounds[-1]]).translate(_LETTERS) if len(text) and bounds[-1] > bounds[0] else b""
    plain = pa.StringArray.from_buffers(len(text), pa.py_buffer((bounds - bounds[0]).astype(np.int32).tobytes()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full, dtype=np.int64)))
    bounds = lists.offsets.to_numpy()
    coded = flat.filter(pa.array(full)).dictionary_encode()
    codes = coded.indices.to_numpy()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return Worded(codes, coded.dictionary, own[codes] if len(own) else np.zeros(0, np.uint64), before[bounds - bounds[0]])


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` words from each word on, across the bounds of texts; the last ``width`` - 1 are missing."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k])
    return out


def inside(own: Worded, width: int) -> np.ndarray:
    """The words from which ``width`` words lie in one text."""
    n = np.maximum(0, own.counts - width + 1)
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(own.offsets[:-1] - (ends - n), n)


def lists_of(own: Worded, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of ``sizes`` words from the words ``starts`` on."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), own.vocabulary.take(pa.array(own.codes[at])))


@dataclass
class Filter:
    """A Bloom filter of 64-bit hashes; ``bits`` are packed, a power of two in all."""

    bits: np.ndarray

    def _place(self, h: np.ndarray, probe: int) -> np.ndarray:
        return ((h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(8 * len(self.bits) - 1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        """The places of the hashes that it holds, but for few others."""
        at = np.arange(len(h))
        for probe in range(PROBES):
            place = self._place(h[at], probe)
            at = at[(self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
        return at


def bloom(shingles: DataFrame, most_bits: int) -> Filter:
    """The filter of rows (shingle long): 32 bits a row up to ``most_bits``, built segment by segment.

    Its size is all that is held by a task or sent to all; with more rows more places are taken for hits and joined.
    """
    n = shingles.count()
    bits = min(most_bits, max(SEGMENT, 1 << int(32 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(np.zeros(bits // 8, np.uint8))
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([own._place(h, k) for k in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT), pa.array(at % SEGMENT)], ["segment", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, place = (batch.column(k).to_numpy() for k in range(2))
            for k in np.unique(segment):
                held.setdefault(int(k), np.zeros(SEGMENT, bool))[place[segment == k]] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()])], ["segment", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    filled = shingles.select("shingle").mapInArrow(places, "segment long, place long").repartition("segment").mapInArrow(pack, "segment long, bits binary")
    for r in filled.toLocalIterator():
        out[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return Filter(out)


def item_windows(items: DataFrame, size: int, width: int) -> DataFrame:
    """(window binary, item_id string, words array, shingles array<long>): each distinct window of each item, in ``items`` (item_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, size=1 << 20)):
            own = words(part.column("text"))
            counts = own.counts
            n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
            owner, long = np.repeat(np.arange(len(n)), n), np.repeat(np.minimum(counts, size), n)
            starts = np.arange(n.sum()) + np.repeat(own.offsets[:-1] - (np.cumsum(n) - n), n)
            for length in np.unique(long):
                mine = np.flatnonzero(long == length)
                w = min(width, int(length))
                g, m = runs(own.hashes, w).view(np.int64), int(length) - w + 1
                shingles = g[starts[mine][:, None] + np.arange(m)]
                told = lists_of(own, starts[mine], long[mine])
                keys = pa.array([xxhash.xxh3_128_digest(x.encode()) for x in pc.binary_join(told, " ").to_pylist()], pa.binary())
                bounds = pa.array(np.arange(len(mine) + 1) * m, pa.int32())
                yield pa.RecordBatch.from_arrays([keys, part.column("item_id").take(pa.array(owner[mine])), told, pa.ListArray.from_arrays(bounds, pa.array(shingles.ravel()))], ["window", "item_id", "words", "shingles"])

    return items.mapInArrow(cut, "window binary, item_id string, words array<string>, shingles array<long>")


def places_of(own: Worded, widths: list[int], found: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, words, shingles) of the shingles within a text that the filter holds."""
    for width in widths:
        at, g = inside(own, width), runs(own.hashes, width)
        g = g if len(at) == len(g) else g[at]
        held = found.has(g)
        yield width, at[held], g[held].view(np.int64)


def frequencies(rows: DataFrame, widths: list[int], found: Broadcast) -> DataFrame:
    """(shingle, n): how often all texts hold each shingle of the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            for _, _, g in places_of(words(part.column("text")), widths, found.value):
                g, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return rows.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """(shingle, k, window, words, need): the rarest shingles of each window, one of which a document must hold.

    A window of m shingles is met where ``need``, the least whole number of ``share`` m or more, stand at their places,
    so one of the m - ``need`` + 1 rarest does. Windows of which documents hold fewer than ``need`` are left out.
    """
    one = windows.groupBy("window").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    each = one.select("window", F.posexplode("shingles").alias("k", "shingle")).join(counts, "shingle", "left")
    # a window has at most as many shingles as words
    ranked = each.groupBy("window").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "k"))).alias("r"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.size("r") - 1e-9)).cast("int")
    ranked = ranked.withColumn("need", need).where(F.size(F.filter("r", lambda x: x["n"] > 0)) >= F.col("need"))
    first = ranked.select("window", "need", F.explode(F.slice("r", F.lit(1), F.size("r") - F.col("need") + 1)).alias("p")).where("p.n > 0")
    return first.select("window", "need", "p.shingle", "p.k").join(one.select("window", "words"), "window")


def hits(rows: DataFrame, widths: list[int], found: Broadcast, size: int, width: int) -> DataFrame:
    """Rows of two kinds: each text's (id, n_words; ``key`` if it holds a shingle of the filter), and each such place.

    Places have ``shingle``, the ``place`` of its first word and ``context``, the words around it that a window could
    take, ``before`` of them before it. Texts are told apart by 128 bits of hash, so equal texts are worked as one later.
    """
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key binary, n_words long, shingle long, width int, place long, before int, context array<string>"
    names = [c.split()[0] for c in schema.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            text, n = part.column("text"), part.num_rows
            own = words(text)
            held, some = [], np.zeros(n, bool)
            for w, at, g in places_of(own, widths, found.value):
                owner = np.searchsorted(own.offsets, at, "right") - 1
                some[owner] = True
                held.append((w, at, g, owner))
            keys = pa.array([xxhash.xxh3_128_digest(text[i].as_buffer()) if x else None for i, x in enumerate(some.tolist())], pa.binary())
            none = lambda t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([part.column("id"), keys, pa.array(own.counts), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.list_(pa.string()))], names)
            for w, at, g, owner in held:
                reach = size - w if w == width else 0
                for a in range(0, len(at), 10_000):
                    p, o = at[a : a + 10_000], owner[a : a + 10_000]
                    begin = np.maximum(p - reach, own.offsets[o])
                    end = np.minimum(p + w + reach, own.offsets[o + 1])
                    columns = [pa.nulls(len(p), part.schema.field("id").type), keys.take(pa.array(o)), pa.array(own.counts[o]), pa.array(g[a : a + 10_000]), pa.array(np.full(len(p), w, np.int32)), pa.array(p - own.offsets[o]), pa.array((p - begin).astype(np.int32)), lists_of(own, begin, end - begin)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("id", "text").mapInArrow(find, schema)


def _dealt(many: DataFrame, few: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """A join whose many rows of one key are dealt to ``SALTS`` parts by another column."""
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    every = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [on, "_salt"], how).drop("_salt")


def matches(places: DataFrame, prefix: DataFrame) -> DataFrame:
    """(key, start, size, window): where the texts' words are the windows', confirmed word by word."""
    joined = _dealt(places, prefix, "shingle", "key")
    start, size = F.col("place") - F.col("k"), F.size("words")
    joined = joined.where((start >= 0) & (start + size <= F.col("n_words")))
    met = F.slice("context", F.col("before") - F.col("k") + 1, size)
    same = lambda i: F.slice(met, i + 1, F.col("width")) == F.slice("words", i + 1, F.col("width"))
    enough = F.size(F.filter(F.sequence(F.lit(0), size - F.col("width")), same)) >= F.col("need")
    return joined.where(enough).select("key", start.alias("start"), size.alias("size"), "window").distinct()


def spans(found: DataFrame) -> DataFrame:
    """(key, n_hit, spans): the words of each text under any match, and their runs [start, end)."""
    places = found.groupBy("key", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    order = Window.partitionBy("key").orderBy("start")
    begun = places.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    run = begun.withColumn("run", F.sum("new").over(order)).groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return run.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, width: int = 5, share: float = 1.0, most_bits: int = 1 << 27) -> DataFrame:
    """What each document holds of the benchmark: (id, ``n_words``, ``n_hit``, ``item_ids``, ``spans``, ``contaminated``).

    ``n_hit`` counts words inside any occurrence of a window, ``spans`` are their runs [start, end) by word,
    ``item_ids`` the items with occurring windows, as strings, sorted. With ``share`` 1 a window occurs where its words
    follow each other exactly; below, where that share of its shingles of ``width`` words stand at their places.

    Null or empty texts, or texts without words, have none and are clean; so have items, which then have no window.
    Items without an id are left out, rows of one item id are one item. Each row of a document's id is judged by its own text and null
    ids stay null; rows with equal texts have equal results. Other columns are not read. Empty tables: no documents
    give no rows, no items leave all clean. A text's matches meet in one task, never those of several texts.
    """
    if not 1 <= width <= size or not 0 < share <= 1:
        raise ValueError("width must lie within size, and share within 0 and 1")
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text(text_col))
    named = items.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), text(item_text_col)).where("item_id is not null")
    windows = stored(item_windows(named, size, width), "leak-windows")
    shingles = windows.select(F.explode("shingles").alias("shingle")).distinct()
    # as many widths as a window has words, at most
    widths = sorted(r[0] for r in windows.select(F.least(F.lit(width), F.size("words"))).distinct().collect())
    send = docs.sparkSession.sparkContext.broadcast
    counts = frequencies(rows, widths, send(bloom(shingles, most_bits)))
    prefix = stored(prefixes(windows, counts, share), "leak-prefixes")
    rare = prefix.select("shingle").distinct()
    held = stored(hits(rows, widths, send(bloom(rare, most_bits)), size, width), "leak-hits")
    found = stored(matches(held.where("shingle is not null"), prefix), "leak-matches")
    own = windows.select("window", "item_id").distinct().join(found.select("window").distinct(), "window", "left_semi")
    of = _dealt(found.select("key", "window").distinct(), own, "window", "key").select("key", "item_id").distinct()
    result = spans(found).join(of.groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids")), "key")
    headers = held.where("shingle is null").select("id", "key", "n_words")
    # equal texts may be many: they are dealt out; texts without a place meet nothing
    met = _dealt(headers.where("key is not null"), result, "key", "id", "left")
    out = met.unionByName(headers.where("key is null"), allowMissingColumns=True)
    none = {"n_hit": F.lit(0), "item_ids": F.array(), "spans": F.array()}
    out = out.withColumns({c: F.coalesce(c, x.cast(result.schema[c].dataType)) for c, x in none.items()})
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "item_ids", "spans", (F.col("n_hit") > 0).alias("contaminated"))
