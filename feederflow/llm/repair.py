"""Token ids in Re-Pair compressed shards that any range can be read from."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feederflow.llm.shared import slices, texts
from feederflow.llm.tokens import crc, encoder, gather

MAGIC, HEADER = b"RPG2", "<4sIQIIQII"  # magic, first nonterminal, ids, documents, rules, symbols, bits a symbol, bits a length
#: Symbols between the noted positions of a shard; bits of the table that sets rare pairs aside.
STRIDE, TABLE = 1024, 18


def compress(ids: np.ndarray, first: int, rounds: int | None = None, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left, and the rules (left, right) of nonterminals ``first``, ``first + 1``, ...

    Neighbouring pairs are replaced in classes of frequency, each half of the one before (and joined with the next
    while it holds less than a 64th of all places): a round counts the pairs of its class exactly and replaces them all; where two overlap, the more frequent one
    is replaced. The rounds end when no pair occurs ``least`` times without overlap, or after ``rounds`` if that is given.

    Every place has a bound of its pair's count, first from a hash table. A pair gains no occurrence after
    the round that made its newer symbol, so bounds hold, and a round looks at the places in its class alone.
    """
    seq, rules, n_rules = ids.astype(np.uint32), [], 0
    bound = np.zeros(len(seq), np.int32)
    bound[:-1] = bounded(seq[:-1], seq[1:])
    floor = max(least, int(bound.max(initial=0)))
    while len(seq) > 1 and (rounds is None or len(rules) < rounds):
        at = np.flatnonzero(bound >= floor)
        if 64 * len(at) < len(seq) and floor > least:
            floor = max(least, floor // 2)
            continue
        if not len(at):
            break
        code = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        counted = alternating(at, code)
        codes, own, seen = np.unique(code[counted], return_inverse=True, return_counts=True)
        bound[at[counted]] = seen[own]
        if not counted.all():
            bound[at[~counted]] = seen[np.searchsorted(codes, code[~counted])]
        at = at[counted]
        # the place in order of frequency, so that the most frequent pair always wins
        rank = np.empty(len(codes), np.int64)
        rank[np.argsort(seen, kind="stable")] = np.arange(len(codes))
        good = seen[own] >= floor
        at, own = at[good], own[good]
        if not len(at):
            continue
        near = at[1:] == at[:-1] + 1
        r = rank[own]
        keep = np.ones(len(at), bool)
        keep[1:] &= ~near | (r[1:] >= r[:-1])
        keep[:-1] &= ~near | (r[:-1] >= r[1:])
        at, own = at[keep], own[keep]
        times = np.bincount(own, minlength=len(codes))
        used = np.flatnonzero(times >= least)
        number = np.full(len(codes), -1, np.int64)
        number[used] = first + n_rules + np.arange(len(used))
        good = number[own] >= 0
        at, own = at[good], own[good]
        rules.append(np.stack((codes[used] >> np.uint64(32), codes[used] & np.uint64(0xFFFFFFFF)), 1).astype(np.uint32))
        n_rules += len(used)
        seq[at] = number[own]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, bound = seq[stay], bound[stay]
        # where the new symbols are now: their pairs, and those with what is before them
        at -= np.arange(len(at))
        new = np.concatenate((at, at[(at > 0) & np.append(True, at[1:] != at[:-1] + 1)] - 1))
        new = new[new < len(seq) - 1]
        bound[new] = bounded(seq[new], seq[new + 1])
        bound[-1] = 0
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def bounded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounds of how often each of the pairs occurs among them: the pairs in its slot of a hash table."""
    bits = min(TABLE, max(10, (2 * len(a)).bit_length()))
    h = (a * np.uint32(0x9E3779B1) ^ (b * np.uint32(0x85EBCA77) + (a >> np.uint32(7)))) >> np.uint32(32 - bits)
    return np.bincount(h, minlength=1 << bits).astype(np.int32)[h]


def alternating(at: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which places to count: all, but of a run of one symbol every other."""
    counted = np.ones(len(at), bool)
    same = np.flatnonzero((code >> np.uint64(32)) == (code & np.uint64(0xFFFFFFFF)))
    if len(same):
        place = at[same]
        begins = np.ones(len(same), bool)
        begins[1:] = place[1:] != place[:-1] + 1
        begin = np.maximum.accumulate(np.where(begins, np.arange(len(same)), 0))
        counted[same[(np.arange(len(same)) - begin) % 2 == 1]] = False
    return counted


def rule_lengths(rules: np.ndarray, first: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many ids every nonterminal stands for, and the nonterminals by level: a level's parts are in earlier ones."""
    n = len(rules)
    part = rules.astype(np.int64) - first
    lengths, levels, left = np.zeros(n, np.int64), [], np.arange(n)
    while len(left):
        size = np.where(part[left] < 0, 1, lengths[np.maximum(part[left], 0)])
        done = (size > 0).all(1)
        lengths[left[done]] = size[done].sum(1)
        levels.append(left[done])
        left = left[~done]
    return lengths, levels


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every nonterminal in a row, and their bounds; a level at a time, those of finished parts."""
    lengths, levels = rule_lengths(rules, first)
    part = rules.astype(np.int64) - first
    bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    out = np.zeros(int(bounds[-1]), np.uint32)
    for level in levels:
        to = bounds[level]
        for side in (0, 1):
            k = part[level, side]
            one = k < 0
            out[to[one]] = rules[level[one], side]
            size = np.where(one, 1, lengths[np.maximum(k, 0)])
            out[gather(to[~one], size[~one])] = out[gather(bounds[k[~one]], size[~one])]
            to = to + size
    return out, bounds


def write_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, rounds: int | None = None) -> bytes:
    """A shard: header, document ids and lengths, rules and their expansion lengths, noted positions, symbols."""
    first = int(ids.max()) + 1
    seq, rules = compress(ids, first, rounds)
    stands_for, _ = rule_lengths(rules, first)
    spans = symbol_lengths(seq, first, stands_for)
    noted = np.concatenate(([0], np.cumsum(spans)))[:-1:STRIDE]
    width, wide = (first + len(rules) - 1).bit_length(), int(stands_for.max(initial=0)).bit_length()
    null = np.array([d is None for d in doc_ids], np.uint8)
    own = np.array([d or 0 for d in doc_ids], "<i8")
    parts = (own, null, lengths.astype("<u4"), packed(rules.ravel(), width), packed(stands_for, wide), noted.astype("<u8"), packed(seq, width))
    return struct.pack(HEADER, MAGIC, first, len(ids), len(own), len(rules), len(seq), width, wide) + b"".join(x.tobytes() for x in parts)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """The numbers' lowest ``width`` bits (up to 32) in a row, as bytes."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little")


def unpacked(data: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def symbol_lengths(seq: np.ndarray, first: int, rule_lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(seq), np.int64)
    high = seq >= first
    out[high] = rule_lengths[seq[high] - first]
    return out


class Shard:
    """A shard as written, for decoding whole or in part."""

    def __init__(self, data: bytes):
        magic, self.first, self.n_ids, docs, rules, symbols, width, wide = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        at = struct.calcsize(HEADER)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        bits = lambda width, n: unpacked(take("u1", -(-n * width // 8)), width, n)
        own, null, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs).astype(np.int64)
        self.doc_ids = [None if z else d for d, z in zip(own.tolist(), null.tolist(), strict=True)]
        self.rules, self.rule_lengths = bits(width, 2 * rules).reshape(-1, 2), bits(wide, rules).astype(np.int64)
        self.noted = take("<u8", -(-symbols // STRIDE)).astype(np.int64)
        self.seq = bits(width, symbols).astype(np.int64)
        flat, bounds = expansions(self.rules, self.first)
        self.table = np.concatenate((np.arange(self.first, dtype=np.uint32), flat))
        self.begins = np.concatenate((np.arange(self.first), self.first + bounds[:-1]))

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        return self.table[gather(self.begins[seq], symbol_lengths(seq, self.first, self.rule_lengths))]

    def all(self) -> np.ndarray:
        return self._expand(self.seq)

    def range(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on; only the symbols between the noted positions around them are expanded."""
        low = max(0, int(np.searchsorted(self.noted, start, side="right")) - 1)
        high = int(np.searchsorted(self.noted, start + n, side="left"))
        return self._expand(self.seq[low * STRIDE : high * STRIDE])[start - self.noted[low] :][:n] if n else np.zeros(0, np.uint32)


def write_tokens(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = 1 << 20, rounds: int | None = None, rows_per_part: int = 10_000, part_bytes: int = 64 << 20) -> None:
    """Write all documents' ids (each with ``end_id`` after it) in ascending id order as compressed shards.

    Documents are dealt out by ranges of their id, of about ``rows_per_part`` rows or ``part_bytes``
    bytes, and sorted; each task encodes its own and cuts shards of about ``shard_ids`` ids between documents. A row of the Parquet table at ``path`` is a
    shard: ``part`` and ``shard`` give its place, ``n_ids`` its ids, ``data`` its bytes.

    Null ids come first, rows with equal ids lie beside each other as the table has them; null or empty text is the end
    id alone. Other columns are not read. An empty table writes an empty table.
    """
    rows = texts(df, id_col, text_col)
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).head()
    parts = max(1, -(-n // rows_per_part), -(-(size or 0) // part_bytes))
    # the row's place in the table parts even an id that a third of all rows have
    ordered = [F.col("doc_id").asc_nulls_first(), F.col("row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held, lengths, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, size
            ids = np.concatenate(held)
            data = write_shard(ids, docs, np.concatenate(lengths), rounds)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})
            shard, size = shard + 1, 0
            for x in (docs, held, lengths):
                x.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole)):
            ids, bounds = encode(batch.column("text"))
            n = np.diff(bounds)
            # the end id after each document
            ids, ends = np.insert(ids, bounds[1:], end_id), bounds[1:] + np.arange(1, len(n) + 1)
            own, k, before = batch.column("doc_id").to_pylist(), 0, 0
            while k < len(own):
                j = max(k + 1, int(np.searchsorted(ends, before + shard_ids - size, side="right")))
                docs.extend(own[k:j])
                held.append(ids[before : ends[j - 1]])
                lengths.append(n[k:j] + 1)
                size += int(ends[j - 1]) - before
                k, before = j, int(ends[j - 1])
                if size >= shard_ids or k < len(own):
                    yield flush()
        if docs:
            yield flush()

    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered)
    dealt.select("doc_id", "text").mapInArrow(run, "part int, shard int, n_ids long, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written table: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Parts follow each other, so a document starts at its part's first id (a running sum over
    parts, one row each) and what precedes it there.
    """
    shards = spark.read.schema("part int, shard int, n_ids long, data binary").parquet(path)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    firsts = shards.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("first")).join(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                shard = Shard(data.as_py())
                ids, ends = shard.all(), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                n = len(starts)
                sums = [crc(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.lengths), pa.array(sums, pa.int64())], ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "shard", "data").mapInArrow(run, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(firsts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
