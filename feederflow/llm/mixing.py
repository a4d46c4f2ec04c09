"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederflow.llm.shared import stored

_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words ``[^ \\t-\\r]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A target for each source: ``share`` of all sizes, by weights that repeat over the sources
    in code point order (null last), none above ``most`` times its own size.

    Filling up stops first where ``most * size / weight`` is least, so the filled sources are a
    prefix in that order and one pass of running sums finds the common level of the others.
    ``sizes`` has a row for each source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_place", F.row_number().over(order) - 1).withColumn("_w", w).withColumn("_cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_place")
    run = up.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    ranked = ranked.withColumn("_all", share * F.sum("source_size").over(all_rows)).withColumn("_filled", F.coalesce(F.sum("_cap").over(run), F.lit(0.0))).withColumn("_open", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(run), F.lit(0.0)))
    level = F.col("_w") * (F.col("_all") - F.col("_filled")) / F.col("_open")
    # the first source that stays below its cap sets the level for all that follow
    ranked = ranked.withColumn("_level", F.when(level <= F.col("_cap"), level / F.col("_w"))).withColumn("_level", F.first("_level", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.select("source", "source_size", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))).cast("double").alias("target"))


def apportion(parties: DataFrame) -> DataFrame:
    """Sainte-Laguë seats of each ``source`` in each ``shard``: the highest quotients votes / (2k - 1) win.

    ``parties`` has (shard, source, votes double, most long); a party gets at most ``most`` seats,
    a shard round(sum of votes). Seats that any divisor near the final one grants are given at
    once, so only about two seats a party are ranked, however many there are.
    """
    shard = Window.partitionBy("shard")
    p = parties.withColumn("_v", F.sum("votes").over(shard)).withColumn("_n", F.count(F.lit(1)).over(shard)).withColumn("_house", F.round("_v"))
    seats = lambda house: F.floor(F.col("votes") * house / F.col("_v") + 0.5)
    low = F.when((F.col("_house") > F.col("_n") / 2) & (F.col("_v") > 0), seats(F.col("_house") - F.col("_n") / 2) - 1).otherwise(0)
    high = F.when(F.col("_v") > 0, seats(F.col("_house") + F.col("_n") / 2) + 1).otherwise(0)
    p = p.withColumn("_low", F.least("most", F.greatest(F.lit(0), low)).cast("long")).withColumn("_high", F.least("most", F.greatest(F.lit(0), high)).cast("long"))
    p = p.withColumn("_left", F.col("_house") - F.sum("_low").over(shard))
    ranked = p.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    best = Window.partitionBy("shard").orderBy(F.when(F.col("_k").isNotNull(), F.col("votes") / (2 * F.col("_k") - 1)).desc_nulls_last(), F.col("source").asc_nulls_last(), "_k")
    won = ranked.withColumn("_won", (F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_left"))).cast("long"))
    return won.groupBy("shard", "source").agg((F.first("_low") + F.sum("_won")).alias("quota"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, rows_per_shard: int = 10_000, seed: int = 42) -> DataFrame:
    """How many words of each document a mix with target weights takes.

    A document belongs to a shard by its id's hash. In a shard, each source's documents lie end
    to end in seeded order, cut into blocks of about ``block`` words, all equal but for a word.
    Sainte-Laguë gives each source its integer quota of the shard's blocks. A quota of q out of n
    blocks takes each q // n times, and q % n of them, chosen by a seeded permutation, once more.
    Adds ``size``, ``source_size``, ``target`` (of its source) and ``taken``; runs agree.

    Returns the id and source columns and the added ones. Null or empty text has size 0 and is
    not taken; null sources are one source, last in order. Rows with equal ids lie beside each
    other, ordered by size; equal rows may swap what is taken of them. An empty table gives an
    empty table.
    """
    size = n_words(F.col(f"`{text_col}`").cast("string"))
    # the text is read for its size alone
    sized = stored(df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    n_shards = max(1, -(-sized.count() // rows_per_shard))
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    placed = sized.withColumn("_seeded", F.xxhash64(F.lit(seed), F.col("_id").cast("string"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id").cast("string")), F.lit(n_shards)))
    parts = placed.groupBy("shard", "source").agg(F.sum("size").alias("_words"))
    parts = parts.join(goals, parts["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    n = F.when(F.col("_words") > 0, F.greatest(F.lit(1), F.round(F.col("_words") / block))).otherwise(0).cast("long")
    parts = parts.withColumn("_n", n).withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("_n")).otherwise(0.0)).withColumn("most", F.floor(most * F.col("_n")))
    parts = stored(parts, "mix-parts")
    quotas = apportion(parts.select("shard", "source", "votes", "most")).select(F.col("shard").alias("_s"), F.col("source").alias("_o"), "quota")
    parts = parts.join(quotas, (parts["shard"] == F.col("_s")) & parts["source"].eqNullSafe(F.col("_o"))).select(F.col("shard").alias("_s"), F.col("source").alias("_o"), "_words", "_n", "quota", "source_size", "target")
    parts = stored(parts, "mix-quotas")
    line = Window.partitionBy("shard", "source").orderBy("_seeded", "_id", "size")
    laid = placed.withColumn("_end", F.sum("size").over(line)).withColumn("_start", F.col("_end") - F.col("size"))
    laid = laid.join(parts, (laid["shard"] == parts["_s"]) & laid["source"].eqNullSafe(parts["_o"]))
    # block j holds the words from floor(j W / n) to floor((j + 1) W / n)
    edge = lambda j: F.floor(j * F.col("_words") / F.col("_n")).cast("long")
    first = F.floor(F.col("_start") * F.col("_n") / F.col("_words")).cast("long")
    last = F.floor((F.col("_end") - 1) * F.col("_n") / F.col("_words")).cast("long")
    # a prime above any number of blocks in a shard makes j -> (prime j + shift) mod n a permutation
    chosen = lambda j: (F.pmod(F.lit(1_000_000_007) * j + F.pmod(F.xxhash64(F.lit(seed + 2), F.col("shard"), F.col("source")), F.lit(1_000_003)), F.col("_n")) < F.pmod(F.col("quota"), F.col("_n"))).cast("long")
    share_of = lambda j: F.greatest(F.lit(0), F.least(F.col("_end"), edge(j + 1)) - F.greatest(F.col("_start"), edge(j))) * (F.floor(F.col("quota") / F.col("_n")) + chosen(j))
    taken = F.when(F.col("size") > 0, F.aggregate(F.sequence(F.greatest(F.lit(0), first - 1), F.least(F.col("_n") - 1, last + 1)), F.lit(0).cast("long"), lambda s, j: s + share_of(j))).otherwise(0).cast("long")
    return laid.select(F.col("_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))
