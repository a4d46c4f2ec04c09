"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feederflow.llm.shared import SPACE, Words, shingles, slices, stored

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A measure, ``(count + half) / per``, and where a group's fences lie.

    Measures are compared as ratios. The upper fence is the median times the ``reach``-th power of the ratio of the
    quantile ``at`` to it, or, for a two-sided rule, the fences are the median times and divided by the
    ``reach``-th power of the root of the ratio of the quantiles ``at`` and 1 - ``at``. ``at`` says how large a share of a
    group may be junk: beyond it junk sets the fence. ``half`` a count is added where most texts have none: a text
    without any then counts the more the shorter it is, so that the lengths of a group's texts spread its fence.
    """

    name: str
    count: str
    per: str
    at: float
    reach: float
    half: float = 0.5
    two_sided: bool = False

    @property
    def quantiles(self) -> tuple[float, ...]:
        return (1 - self.at, 0.5, self.at) if self.two_sided else (0.5, self.at)

    def log_measure(self, of: str = "") -> str:
        """Null for a text without what is counted per."""
        return f"ln((cast({of}{self.count} as double) + {self.half}) / nullif({of}{self.per}, 0))"


RULES = (
    Rule("symbols", "n_symbols", "n_words", at=0.8, reach=3.0),
    Rule("repeats", "n_repeat_words", "n_words", at=0.99, reach=1.5),
    Rule("dup_lines", "n_dup_lines", "n_lines", at=0.99, reach=1.5),
    Rule("word_length", "word_chars", "n_words", at=0.9, reach=5.0, half=0.0, two_sided=True),
)
#: Buckets of a sketch for a factor of e: values of one bucket differ by 1 % at most.
BUCKETS = 100


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each whole text, a batch at a time."""
    for batch in (part for whole in batches for part in slices(whole)):
        text = batch.column("text")
        words = Words(text)
        owners, n = words.owners(), len(text)
        by_text = lambda own: np.bincount(owners, own[words.codes], n).astype(np.int64) if len(own) else np.zeros(n, np.int64)
        chars = pc.utf8_length(words.vocabulary).to_numpy()
        symbols = pc.count_substring_regex(words.vocabulary, f"[{SYMBOLS}]").to_numpy()
        dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, t in enumerate(text.to_pylist()):
            own = [x for x in (t or "").split("\n") if x.strip(SPACE)]
            lines[i] = len(own)
            dup[i] = len(own) - len(set(own))
        columns = [batch.column("_row"), *(pa.array(x) for x in (words.counts, by_text(chars), by_text(symbols), dup, repeated(words), lines))]
        yield pa.RecordBatch.from_arrays(columns, ["_row", *COUNTS])


def covered(words: Words, width: int = 3) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words that occurs twice or more in its text."""
    windows, bounds = shingles(words, width)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(windows ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    w, o = windows[order], owner[order]
    same = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
    starts = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    starts = starts + (words.offsets[:-1] - bounds[:-1])[owner[starts]]
    out = np.zeros(len(words.codes) + width, bool)
    for k in range(width):
        out[starts + k] = True
    return out[: len(words.codes)]


def repeated(words: Words, width: int = 3) -> np.ndarray:
    """Words in repeated windows by text."""
    total = np.concatenate(([0], np.cumsum(covered(words, width))))
    return total[words.offsets[1:]] - total[words.offsets[:-1]]


def sketches(measured: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(lang, source, rule, bucket, n): a histogram of each measure by group, with buckets of equal ratio.

    Counts of buckets add up, so sketches merge exactly, in any order, and the same rows always give the same sketch.
    """
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.floor(F.expr(r.log_measure()) * BUCKETS).cast("int").alias("bucket")) for k, r in enumerate(rules)])
    rows = measured.where("not base_failed").select("lang", "source", F.explode(each).alias("r")).where("r.bucket is not null")
    return rows.groupBy("lang", "source", "r.rule", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, rules: tuple[Rule, ...], *keys: str) -> DataFrame:
    """(keys, n, q): the rules' quantiles in logarithms, one after the other, from sketches merged by ``keys``."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    # a sketch has as many buckets as its values' range in logarithms asks for, however many rows it counts
    same = Window.partitionBy(*keys, "rule")
    up_to = merged.select("*", F.sum("n").over(same.orderBy("bucket")).alias("below"), F.sum("n").over(same).alias("all"))
    wanted = [(k, q) for k, r in enumerate(rules) for q in r.quantiles]
    picked = [F.min(F.when((F.col("rule") == k) & (F.col("below") >= q * F.col("all")), F.col("bucket"))) for k, q in wanted]
    return up_to.groupBy(*keys).agg(F.max("all").alias("n"), F.array(*[(x + 0.5) / BUCKETS for x in picked]).alias("q"))


def fences(measured: DataFrame, rules: tuple[Rule, ...], prior_rows: float) -> DataFrame:
    """(lang, source, n, fence): bounds of each group, in logarithms, from sketches of the rows that pass the base rules.

    A language's sketch and that of all rows are merged from the groups', without reading
    rows again. A group's quantiles are averaged with its language's, which counts like ``prior_rows``
    rows, and a language's likewise with all rows': a small group follows the wider sketch, a large one its own.
    Null languages and sources are groups of their own; without rows that pass there are no fences.
    """
    own = stored(sketches(measured, rules), "quality-sketches")
    every = quantiles(own, rules).where("n > 0").select(F.col("q").alias("all_q"))
    langs = quantiles(own, rules, "lang").select(F.col("lang").alias("_lang"), F.col("n").alias("lang_n"), F.col("q").alias("lang_q"))
    near = lambda n, q, wide: F.zip_with(q, wide, lambda x, y: (F.col(n) * x + prior_rows * y) / (F.col(n) + prior_rows))
    joined = quantiles(own, rules, "lang", "source").join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(every), F.lit(True))  # one row
    shrunk = joined.select("lang", "source", "n", near("n", F.col("q"), near("lang_n", F.col("lang_q"), F.col("all_q"))).alias("q"))
    bounds, k = [], 0
    for r in rules:
        q = [F.get("q", F.lit(k + j)) for j in range(len(r.quantiles))]
        k += len(q)
        if r.two_sided:
            spread = r.reach * (q[2] - q[0]) / 2
            bounds += [(q[1] + spread).alias(f"{r.name}_max"), (q[1] - spread).alias(f"{r.name}_min")]
        else:
            bounds.append((q[0] + r.reach * (q[1] - q[0])).alias(f"{r.name}_max"))
    return shrunk.select("lang", "source", "n", F.struct(*bounds).alias("fence"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeats: float = 0.5, prior_rows: float = 200.0) -> DataFrame:
    """Counts and a verdict for each document: (id, counts, ``base_failed``, ``kept``, ``broken``).

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeats`` of them in
    repeated 3-word windows. Others are kept if every measure lies within the fences of their
    language and source (see ``fences``); ``broken`` names the rules whose fences they are beyond.

    Null or empty text has no words and fails; null languages or sources are groups of their
    own; a null id stays null; repeated rows get a row each, with equal verdicts. Other columns
    are not read. An empty table gives an empty table.
    """
    rows = df.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source")).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    row = rows.schema["_row"].dataType.simpleString()
    counted = rows.mapInArrow(measure, f"_row {row}, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = F.expr(f"n_words < {least_words} or n_repeat_words > {most_repeats} * n_words")
    measured = stored(counted.select("_row.*", *COUNTS).withColumn("base_failed", failed), "quality-counts")
    bounds = fences(measured, rules, prior_rows).drop("n")
    joined = measured.alias("m").join(bounds.alias("f"), F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source")), "left")
    broken = []
    for r in rules:
        # a value counts as its bucket, so that the very values which a fence comes from lie within it
        value = (F.floor(F.expr(r.log_measure("m.")) * BUCKETS) + 0.5) / BUCKETS
        out = value > F.col(f"f.fence.{r.name}_max") + 1e-9
        if r.two_sided:
            out = out | (value < F.col(f"f.fence.{r.name}_min") - 1e-9)
        broken.append(F.when(out & ~F.col("base_failed"), F.lit(r.name)))
    found = joined.withColumn("broken", F.array_compact(F.array(*broken)))
    return found.select(F.col("m.id").alias(id_col), *[F.col(f"m.{c}") for c in COUNTS[:-1]], "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")
