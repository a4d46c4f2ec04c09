"""Helpers that several operators share: the shared folder, Arrow word splitting, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word and line rules: blank, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Unset, a temporary folder serves, but only where all of Spark is one local process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and it outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that a column has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` long and ``text`` string (null: empty), whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    """Without columns that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 6 << 20, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of text and ``rows`` rows, which bounds what a step over a part takes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words ``[^ \\t-\\r]+`` of a batch of texts: ``codes`` into ``vocabulary``, and ``offsets`` by text."""

    def __init__(self, batch: pa.Array, lower: bool = False):
        if isinstance(batch, pa.ChunkedArray):
            batch = batch.combine_chunks()
        batch = pc.fill_null(batch, "")
        if lower:
            batch = pc.ascii_lower(batch)
        lists = pc.ascii_split_whitespace(batch)
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(full, dtype=np.int64)))
        self.offsets = before[bounds - bounds[0]]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.vocabulary = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in text order."""
        of = xxhash.xxh3_64_intdigest
        own = np.fromiter(map(of, self.vocabulary.cast(pa.binary()).to_pylist()), np.uint64, len(self.vocabulary))
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)

    def owners(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words and their bounds by text.

    A text with fewer words is one shingle; one without words has none.
    """
    h, counts = words.hashes(), words.counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(n)))
    starts = np.arange(bounds[-1]) + np.repeat(words.offsets[:-1] - bounds[:-1], n)
    span = np.repeat(np.minimum(counts, width), n)
    out = span.astype(np.uint64)
    for k in range(width):
        inside = span > k
        if inside.all():
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[starts + k])
        elif inside.any():
            out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[starts[inside] + k])
    return out, bounds
