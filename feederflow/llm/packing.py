"""Vector best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.shared import slices, stored, texts
from feederflow.llm.tokens import crc, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = f"{PIECES}, sequence_id long, offset long"


class Bins:
    """Open bins with their residual tokens, documents and attention cost (as shares of the capacities)."""

    def __init__(self, capacity: np.ndarray, weights: np.ndarray, rule: str):
        self.capacity, self.weights, self.rule = capacity, weights, rule
        self.free, self.n = np.empty((256, 3)), 0

    def place(self, demand: np.ndarray) -> tuple[int, float]:
        """The bin for an item and the tokens already in it. The best fit among bins that meet every constraint, or a new bin."""
        free = self.free[: self.n]
        fits = np.flatnonzero((free[:, 0] >= demand[0]) & (free[:, 1] >= demand[1]) & (free[:, 2] >= demand[2]))
        if len(fits):
            left = (free[fits] - demand) / self.capacity
            if self.rule == "norm":  # the smallest weighted norm of what stays free
                best = fits[np.argmin((left * left) @ self.weights)]
            else:  # the largest weighted dot product of the item with what is taken
                best = fits[np.argmax((1 - free[fits] / self.capacity) @ (self.weights * demand / self.capacity))]
        else:
            if self.n == len(self.free):
                self.free = np.concatenate((self.free, np.empty_like(self.free)))
            best = self.n
            self.free[best] = self.capacity
            self.n += 1
        used = self.capacity[0] - self.free[best, 0]
        self.free[best] -= demand
        return int(best), used


def pack_lengths(lengths: np.ndarray, size: int, max_docs: int, max_cost: float, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item of at most ``size`` tokens, the longest placed first.

    An item demands its tokens, one document and its squared length, the cost of attention. One
    that takes all tokens, or as much as the whole cost or more, has a bin of its own.
    """
    capacity = np.array([size, max_docs, max_cost], float)
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = (lengths == size) | (lengths.astype(float) ** 2 >= max_cost)
    bin_of[full] = np.arange(full.sum())
    bins, base = Bins(capacity, np.array(weights, float), rule), int(full.sum())
    rest = np.flatnonzero(~full)
    for i in rest[np.argsort(-lengths[rest], kind="stable")]:
        n = float(lengths[i])
        at, used = bins.place(np.array([n, 1.0, n * n]))
        bin_of[i], offset[i] = base + at, used
    return bin_of, offset


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, max_docs: int = 4096, max_cost: float | None = None, rule: str = "norm", group: int = 20_000, max_parts: int = 20_000) -> DataFrame:
    """Pack documents (their ids, then ``end_id``) into sequences of at most ``size`` tokens.

    Only longer documents are cut, into pieces of ``size``; the last may be shorter. A
    sequence holds at most ``max_docs`` pieces and a summed squared length of ``max_cost``
    (null: ``size`` squared, which never binds before the tokens do); a piece that costs more by itself is
    alone. Tasks encode their rows and deal the pieces (numbers, no texts or ids) out evenly to groups of about
    ``group``, whatever the rows' partitions; each group is packed by itself and leaves a
    sequence or two partly filled. Beyond ``max_parts`` groups a task packs several, one after the other.

    Null or empty text is the end id alone; a null id stays null. Repeated rows are packed once
    each. Other columns are not read. An empty table gives an empty table.
    """
    cost = float(size) ** 2 if max_cost is None else float(max_cost)
    if cost < 1 or max_docs < 1:
        raise ValueError("max_cost and max_docs: 1 or more")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, slot = encoder(tokenizer), TaskContext.get().partitionId() * 7_919
        for batch in (part for whole in batches for part in slices(whole)):
            ids, bounds = encode(batch.column("text"))
            # the end id after each document
            ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            n = np.diff(bounds)
            pieces = -(-n // size)
            own = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(size, n[own] - start)
            begin = bounds[own] + start
            sums = [crc(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(slot + np.arange(len(own)))], [*names[:5], "slot"])
            slot += len(own)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            bin_of, offset = pack_lengths(np.concatenate([b.column("length").to_numpy() for b in held]), size, max_docs, cost, rule=rule)
            at = 0
            for b in held:
                to = slice(at, at + b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bin_of[to] + base), pa.array(offset[to])], names)
                at += b.num_rows
            base += int(bin_of.max()) + 1
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * group:
                yield from flush()
        if any(b.num_rows for b in held):
            yield from flush()

    pieces = stored(texts(df, id_col, text_col).mapInArrow(cut, f"{PIECES}, slot long"), "packing-pieces")
    parts = max(1, min(max_parts, -(-pieces.count() // group)))
    dealt = pieces.repartitionById(parts, F.pmod("slot", F.lit(parts)).cast("int"))
    return dealt.select(*names[:5]).mapInArrow(fill, SCHEMA)
