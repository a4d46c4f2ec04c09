"""A corpus through five stages: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, and stay within what their predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederflow.llm import line_dedup, minhash, mixing, packing, quality
from feederflow.llm.shared import fresh, stored

SEED = 42
#: Pieces that a sequence holds at most: it binds where texts are shorter than about 85 tokens.
MOST_DOCS = 48


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; all rows of an id, or without one, go if one is rejected.

    Null and empty texts are rejected. An empty table stays empty; other columns are kept as they are.
    """
    gone = quality.quality_rules(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; ``n_chars`` follows the text.

    Rows without an id, and null texts, stay as they are; equal rows lose the same lines. Columns named
    like the operator's own (``n_lines``, ``n_dropped``, ``kept_text``) are kept.
    """
    (own,) = fresh(docs, "row")
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own))
    out = line_dedup.line_dedup(whole)
    cut = F.col("n_dropped") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("kept_text")).otherwise(F.col(own)["n_chars"]).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[changed.get(c, F.col(own)[c]).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).

    The one with the smallest id stays, with all rows of that id; rows without an id or without words stay.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: taken / size, rounded up or down by its id's hash.

    The hash rounds up with the probability of the fraction, so a source's words come near
    its target with whole documents only. Documents without words stay once. Rows with equal ids, or
    without one, are taken equally often.
    """
    mixed = mixing.mix_sources(docs, seed=SEED).groupBy("doc_id").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    even = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(1 << 20)) / (1 << 20)
    times = mixed.select(F.col("doc_id").alias("_id"), F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + even)).otherwise(1).cast("int").alias("_times")).where("_times > 0")
    key, n, copy = fresh(docs, "id", "times", "copy")
    times = times.toDF(key, n)
    copied = docs.join(times, docs["doc_id"].eqNullSafe(F.col(key))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    return copied.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens and ``MOST_DOCS`` pieces; null texts are the end token alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_docs=MOST_DOCS)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("source mix", mix_stage),
    ("packing", pack_stage),
]

#: SQL cannot express sketches, MinHash or tokens; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
