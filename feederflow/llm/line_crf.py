"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederflow.llm.quality import covered
from feederflow.llm.shared import Words, slices, texts

#: What is counted in each word of a line; five times its share of the characters, 1 at most.
CLASSES = {"symbols": "[#*$%&<>]", "pipes": r"\|", "shouts": "!", "capitals": "[A-Z]", "digits": "[0-9]", "stops": "[.,;:?]"}
FEATURES = (*CLASSES, "doubled", "repeated", "same_line", "long_words", "short_words", "short_line")


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES) from 0 to 1, the lines' weights in words, and line bounds by text."""
    lists = pc.split_pattern(pc.fill_null(text, ""), "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    lines = lists.flatten()
    words = Words(lines)
    n = np.maximum(words.counts, 1)
    total = lambda each: np.diff(np.concatenate(([0.0], np.cumsum(each)))[words.offsets])
    size = pc.utf8_length(words.vocabulary).to_numpy().astype(float)
    chars = total(size[words.codes])
    columns = [np.minimum(1, 5 * total(pc.count_substring_regex(words.vocabulary, p).to_numpy()[words.codes]) / np.maximum(chars, 1)) for p in CLASSES.values()]
    doubled = np.zeros(len(words.codes))
    doubled[1:] = words.codes[1:] == words.codes[:-1]
    doubled[words.offsets[:-1][words.counts > 0]] = 0
    columns.append(total(doubled) / n)
    # the same words, taken as one sequence for each text
    whole = Words.__new__(Words)
    whole.codes, whole.vocabulary, whole.offsets = words.codes, words.vocabulary, words.offsets[bounds]
    columns.append(total(covered(whole)) / n)
    coded = lines.dictionary_encode().indices.to_numpy().astype(np.uint64)
    owner = np.repeat(np.arange(len(text)), np.diff(bounds))
    _, back, times = np.unique((owner.astype(np.uint64) << np.uint64(32)) | coded, return_inverse=True, return_counts=True)
    columns.append(((times[back] > 1) & (words.counts > 0)).astype(float))
    columns += [np.clip(chars / n - 4, 0, 8) / 8, total((size <= 3)[words.codes].astype(float)) / n, (words.counts < 5).astype(float)]
    return np.stack(columns, 1), n.astype(float), bounds


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bias, a line's own features, and those of the lines before and after it in its text (else 0)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.concatenate((np.ones((len(x), 1)), x, before, after), 1)


@dataclass
class Crf:
    """Two labels, bad (0) and good (1): a good line scores ``weights`` x features, a step ``steps[from, to]``."""

    weights: np.ndarray
    steps: np.ndarray

    def run(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of good, log normalisers by text, and summed step marginals (2 x 2)."""
        score = np.zeros((len(x), 2))
        score[:, 1] = x @ self.weights
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        start, n = bounds[:-1][order], n[order]
        forward, backward = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        longest = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")  # texts with more than t lines
        for t in range(longest):
            at = start[: active[t]] + t
            forward[at] = score[at] + (np.logaddexp.reduce(forward[at - 1][:, :, None] + self.steps, axis=1) if t else 0)
        for t in range(longest - 2, -1, -1):
            at = start[: active[t + 1]] + t
            backward[at] = np.logaddexp.reduce(self.steps + (score[at + 1] + backward[at + 1])[:, None, :], axis=2)
        norm = np.zeros(len(n))
        norm[order] = np.logaddexp.reduce(forward[start + n - 1], axis=1)
        each = np.repeat(norm, np.diff(bounds))
        good = np.exp(np.clip(forward[:, 1] + backward[:, 1] - each, -700, 0))
        inner = np.ones(len(x), bool)
        inner[bounds[:-1]] = False
        b = np.flatnonzero(inner)
        pair = forward[b - 1][:, :, None] + self.steps + (score[b] + backward[b])[:, None, :] - each[b][:, None, None]
        return good, norm, np.exp(np.clip(pair, -700, 0)).sum(0)


def fit(x: np.ndarray, bounds: np.ndarray, label: np.ndarray, penalty: float = 0.05, rounds: int = 150, rate: float = 0.15) -> Crf:
    """Maximum penalised likelihood; every line of a text carries the text's label. Adam on the whole sample."""
    model = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(label):
        return model
    y = np.repeat(label, np.diff(bounds)).astype(float)
    pairs = np.diff(bounds) - 1
    seen = np.array([[pairs[label == 0].sum(), 0], [0, pairs[label == 1].sum()]], float)
    p = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        model = Crf(p[:-4], p[-4:].reshape(2, 2))
        good, _, stepped = model.run(x, bounds)
        slope = np.concatenate((x.T @ (y - good), (seen - stepped).ravel())) / len(label) - penalty * p / len(label)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        p = p + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Crf(p[:-4], p[-4:].reshape(2, 2))


def held_out(doc_id):
    """Whether a row's label may not be learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4_000, max_lines: int = 500) -> Crf:
    """Fit on at most ``max_docs`` labelled documents that are not held out, of at most ``max_lines`` lines.

    They are those with the least hash of their id. The bound keeps what reaches the driver
    (line features, no texts) small at any input; scoring has no such bound.
    """
    ids = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    drawn = ids.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_docs)  # 16 bytes each
    rows = texts(df, id_col, text_col).join(F.broadcast(drawn), "doc_id").where(F.size(F.split("text", "\n")) <= max_lines)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, bounds = line_features(batch.column("text"))
            x = x.astype(np.float32)
            data = [x[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(data, pa.binary())], ["doc_id", "label", "lines"])

    got = sorted(tuple(r) for r in rows.select("doc_id", "label", "text").mapInArrow(lines, "doc_id long, label int, lines binary").collect())
    parts = [np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)) for _, _, x in got]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
    x = np.concatenate(parts).astype(float) if parts else np.zeros((0, len(FEATURES)))
    if not parts:
        return Crf(np.zeros(1 + 3 * len(FEATURES)), np.zeros((2, 2)))
    return fit(with_neighbours(x, bounds), bounds, np.array([y for _, y, _ in got]))


def score_quality(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Each document's quality: its lines' marginals of good by forward-backward, weighted by their words.

    Returns (id, ``score`` from 0 to 1, ``predicted``: 1 from ``threshold`` on). Null or empty text
    is one empty line and is scored like one; a null id stays null; repeated rows get a row
    each. Only the text is an input of the score. An empty table gives an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=2_000):
                x, weight, bounds = line_features(part.column("text"))
                good, _, _ = model.run(with_neighbours(x, bounds), bounds)
                share = np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])
                share = np.clip(share, 0, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(share), pa.array((share >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int").withColumnRenamed("doc_id", id_col)


def accuracy(scored: pd.DataFrame) -> float:
    """Share of rows (``predicted``, ``label``) that agree."""
    return float((scored["predicted"] == scored["label"]).mean())
