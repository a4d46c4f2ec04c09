r"""Fill-in-middle texts: units found by arithmetic on 64-bit words of the UTF-8 bytes.

A unit is a run of words' characters with the white space before it, or white space that ends a text:
``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``. White space is ASCII, so bytes suffice to find units.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feederflow.llm.shared import fresh, slices

SENTINELS = ("<P>", "<S>", "<M>")
#: Each byte of a word: its lowest bit, its highest, and the seven others.
LOW, HIGH, REST = (np.uint64(0x0101010101010101 * k) for k in (1, 0x80, 0x7F))
#: Words marked at a time, which bounds what the steps between take.
BLOCK = 1 << 16


def spaces(w: np.ndarray) -> np.ndarray:
    """The highest bit of each byte that is a blank or tab to carriage return; sums stay within their bytes."""
    seven = w & REST
    blank = seven ^ np.uint64(0x20) * LOW
    control = (seven + np.uint64(0x80 - 0x09) * LOW) & ~(seven + np.uint64(0x80 - 0x0E) * LOW)
    return (~(blank + REST) | control) & ~w & HIGH


def unit_ends(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words in which the highest bit of a byte marks the end of a unit.

    ``data`` holds the texts' bytes as little-endian words, ``last`` the place of each text's last byte.
    """
    out = np.empty(len(data), np.uint64)
    for at in range(0, len(data), BLOCK):
        s = spaces(data[at : at + BLOCK + 1])
        after = np.append(s[1:], np.uint64(0))[: min(BLOCK, len(data) - at)]
        s = s[: len(after)]
        # white space in the next byte, for a word's last byte in the next word
        out[at : at + BLOCK] = ~s & ((s >> np.uint64(8)) | (after << np.uint64(56))) & HIGH
    np.bitwise_or.at(out, last >> 3, np.uint64(0x80) << (np.uint64(8) * (last & 7).astype(np.uint64)))
    return out


class Units:
    """Ends of units in a buffer of texts: how many lie before a byte, and where the k-th is."""

    def __init__(self, data: np.ndarray, last: np.ndarray):
        self.marks = unit_ends(data, last)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ends before each byte."""
        below = (np.uint64(1) << (np.uint64(8) * (at & 7).astype(np.uint64))) - np.uint64(1)
        marks = np.append(self.marks, np.uint64(0))
        return self.before[at >> 3] + np.bitwise_count(marks[at >> 3] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th end, from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left = (k - self.before[word]).astype(np.uint64)
        # bytes of a word with fewer ends up to and with them than are sought: running sums by a product
        sums = (self.marks[word] >> np.uint64(7)) * LOW
        fewer = ((HIGH | (left - np.uint64(1)) * LOW) - sums) & HIGH
        return word * 8 + np.bitwise_count(fewer)


def cut(text: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, bytes before the first cut, bytes before the second) of each text."""
    bounds = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    start, size = bounds[0], int(bounds[-1] - bounds[0])
    data = np.zeros(-(-size // 8), np.uint64)
    if size:
        data.view(np.uint8)[:size] = np.frombuffer(text.buffers()[2], np.uint8)[start : start + size]
    bounds = bounds - start
    full = bounds[1:] > bounds[:-1]
    units = Units(data, bounds[1:][full] - 1)
    ranks = units.rank(bounds)
    n = np.diff(ranks)
    places = []
    for k in np.sort(np.stack((h1 % (n + 1), h2 % (n + 1))), axis=0):
        inside = k > 0
        place = np.zeros(len(n), np.int64)
        place[inside] = units.select(ranks[:-1][inside] + k[inside]) + 1 - bounds[:-1][inside]
        places.append(place)
    return n, *places


def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = [[np.zeros(0, np.int64)] for _ in range(3)]
    whole = pa.RecordBatch.from_arrays([pc.fill_null(text, ""), h1, h2], ["text", "h1", "h2"])
    for part in slices(whole):
        for out, x in zip(found, cut(part.column(0), *(part.column(k).to_numpy() for k in (1, 2))), strict=True):
            out.append(x)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in found], ["n", "first", "second"])


def _distinct(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may begin inside another, so that each is found where it was put."""
    inside = any(a in b for a, b in permutations(sentinels, 2))
    if inside or any(b.startswith(a[k:]) for a in sentinels for b in sentinels for k in range(1, len(a))):
        raise ValueError(f"sentinels overlap: {sentinels}")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Adds ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Of 100 texts about ``rate`` are cut at two random ends of units into prefix, middle and suffix, ``spm`` of
    100 of them written suffix first, the others prefix first, with ``sentinels`` before prefix, suffix and middle.
    All draws follow from the seed and the id, so rows of an id with one text agree and reruns too.

    Null and empty texts, and texts that hold a sentinel, stay plain: ``output`` is the text (null: empty), ``prefix_chars``
    and ``middle_chars`` are null. A null id draws like an empty one. Columns named like the
    added ones are replaced. Repeated rows get a row each, an empty table gives an empty table.
    """
    _distinct(sentinels)
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in added]
    hidden, body, where = fresh(df, "draws", "body", "where")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    draws = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substr(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.withColumns({hidden: draws, body: text})
    h = lambda k: F.get(hidden, F.lit(k))
    rows = rows.withColumn(where, F.arrow_udf(_cuts, "n long, first long, second long")(F.col(body), h(0), h(1)))
    plain = (F.col(body) == "") | (h(2) % 100 >= rate)
    for s in sentinels:
        plain = plain | F.contains(F.col(body), F.lit(s))
    form = F.when(plain, "plain").when(h(3) % 100 < spm, "spm").otherwise("psm")
    raw, a, b = F.col(body).cast("binary"), F.col(where)["first"], F.col(where)["second"]
    piece = lambda begin, size: F.substr(raw, begin.cast("int"), size.cast("int")).cast("string")
    prefix, middle, suffix = piece(F.lit(1), a), piece(a + 1, b - a), piece(b + 1, F.octet_length(raw) - b)
    p, s, m = (F.lit(x) for x in sentinels)
    output = F.when(F.col("form") == "plain", F.col(body)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    chars = lambda x: F.when(F.col("form") != "plain", F.char_length(x).cast("long"))
    # named apart from the table's own columns until the last step
    out = rows.select(*kept, F.col(where)["n"].alias("n"), form.alias("form"), F.col(body), F.col(where))
    return out.select(*kept, "n", "form", chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` was given (null: empty), from its output and form."""
    p, s, m = (F.lit(x) for x in sentinels)
    middle = F.split_part(output, m, F.lit(2))
    head = F.split_part(output, m, F.lit(1))
    psm = F.concat(F.split_part(F.split_part(head, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(head, s, F.lit(2)))
    spm = F.concat(F.split_part(head, p, F.lit(2)), middle, F.split_part(F.split_part(head, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
