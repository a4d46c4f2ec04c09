"""Fill-in-middle: units by words against a pattern, round trips, edges, and the query against a plain version."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feederflow.llm import fim
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output sha, text sha)."""
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, brute.sha(text), brute.sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, form, len(prefix), len(middle), brute.sha(out), brute.sha(text)


def check_cuts(texts, seed=1):
    rng = random.Random(seed)
    h1, h2 = (np.array([rng.randrange(2**32) for _ in texts]) for _ in range(2))
    n, first, second = fim.cut(pa.array(texts, pa.string()), h1, h2)
    for t, x, y, *got in zip(texts, h1, h2, n, first, second, strict=True):
        units = UNIT.findall(t)
        a, b = sorted((int(x) % (len(units) + 1), int(y) % (len(units) + 1)))
        assert got == [len(units), len("".join(units[:a]).encode()), len("".join(units[:b]).encode())]


def test_units_of_all_bytes():
    rng = random.Random(2)
    letters = [chr(k) for k in range(0x21, 0x30)] + [chr(k) for k in range(0x21)] + ["\x7f", "\x85", "\xa0", "é", "€", " ", "😀", "Ā"]
    check_cuts(["".join(rng.choices(letters, k=rng.randrange(0, 40))) for _ in range(5000)] + ["", " ", "a", " " * 8, "x" * 8, "x" * 7 + " ", "\t" * 17])


def test_units_across_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 3)
    rng = random.Random(3)
    check_cuts(["".join(rng.choices("ab \n", k=rng.randrange(0, 200))) for _ in range(300)])


def test_units_of_a_slice_of_texts():
    texts = pa.array(["one two", "three  four ", "", "five six seven"], pa.string()).slice(1, 3)
    n, *_ = fim.cut(texts, np.zeros(3, np.int64), np.zeros(3, np.int64))
    assert n.tolist() == [3, 0, 3]


def test_edges(spark):
    long = "wort äö \n" * 900_000
    rows = [(1, None), (2, ""), (3, "a <M> b"), (None, "x y z"), (5, " \n "), (6, long), (7, "same words here"), (7, "same words here"), (8, "<P"), (9, "S><")]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "doc_id long, text string, output string, body int")
    got = fim.fill_in_middle(df, rate=100)
    assert got.columns == ["doc_id", "text", "body", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert r.back == (r.text or "") and r.n == len(UNIT.findall(r.text or ""))
    assert [by[k].form for k in (1, 2, 3)] == ["plain"] * 3 and by[1].output == "" and by[3].prefix_chars is None
    assert by[6].form != "plain" and len({r.output for r in got if r.doc_id == 7}) == 1
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_pieces_that_look_like_sentinels(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["<", "P", ">", "S", "M", " "], k=rng.randrange(1, 30))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fim.fill_in_middle(df, rate=100, spm=50).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_sentinels_that_overlap_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("", "b", "c"), ("abc", "b", "z")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, sentinels=bad)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    got = entry.queries()["op11_fill_in_middle"](spark, DIR).collect()
    assert {tuple(r) for r in got} == {(d, *plain(d, t)) for d, t in docs} and len(got) == len(docs)
