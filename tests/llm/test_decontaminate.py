"""Decontamination against a plain version: windows, places, shares, hot passages, edges, and the query."""

import hashlib
import os
import random
import re

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from feederflow.llm import decontaminate as d
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(brute.LOWER))


def plain(docs, items, size=10, width=5, share=1.0):
    """[(id, n_words, n_hit, item_ids, spans)]"""
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for doc, t in docs:
        w, hit, ids = words(t), set(), set()
        for g, of in windows.items():
            m = len(g)
            v = min(width, m)
            for k in range(len(w) - m + 1):
                here = w[k : k + m]
                same = sum(tuple(here[i : i + v]) == g[i : i + v] for i in range(m - v + 1))
                if same >= max(1, -(-round(share * (m - v + 1) * 1000) // 1000)):
                    hit.update(range(k, k + m))
                    ids |= of
        starts = sorted(p for p in hit if p - 1 not in hit)
        ends = sorted(p + 1 for p in hit if p + 1 not in hit)
        out.append((doc, len(w), len(hit), sorted(ids), list(zip(starts, ends, strict=True))))
    return out


def run(spark, docs, items, **kw):
    docs = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, key string, n_hit int")
    items = spark.createDataFrame([(*r, "y") for r in items], "item_id string, text string, words string")
    out = d.decontaminate(docs, items, **kw)
    assert out.columns == ["doc_id", "n_words", "n_hit", "item_ids", "spans", "contaminated"]
    got = out.collect()
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["item_ids"], [tuple(s) for s in r.spans]) for r in got), key=repr)


def sample(seed, n_docs=60, n_items=25, vocabulary=6):
    rng = random.Random(seed)
    letters = ["Aa", "b", "é", "Ωx", "d4", "e"][:vocabulary]
    text = lambda n: "".join(w + rng.choice([" ", "-", "\n", "_. "]) for w in rng.choices(letters, k=n))
    items = [(f"i{k}", text(rng.choice([0, 1, 2, 4, 5, 9, 10, 11, 14, 30]))) for k in range(n_items)]
    docs = [(k, text(rng.randrange(0, 60)) + rng.choice(items)[1] + text(rng.randrange(0, 20))) for k in range(n_docs)]
    return docs, items


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(128), rng.randrange(0x80, 0x800), 0x1F600])) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["", None]
    own = d.words(pa.array(["skip", *texts]).slice(1))
    told = own.vocabulary.take(pa.array(own.codes)).to_pylist()
    assert [told[a:b] for a, b in zip(own.offsets[:-1], own.offsets[1:], strict=True)] == [words(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_short_and_long_items(spark, seed):
    docs, items = sample(seed)
    assert run(spark, docs, items) == sorted(plain(docs, items), key=repr)


@pytest.mark.parametrize(("share", "width"), [(0.5, 2), (0.75, 3), (0.4, 5)])
def test_shares(spark, share, width):
    docs, items = sample(7, 40, 12)
    items = [x for x in items if len(words(x[1])) > 3]
    assert run(spark, docs, items, share=share, width=width) == sorted(plain(docs, items, width=width, share=share), key=repr)


def test_full_filter_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "SEGMENT", 64)
    docs, items = sample(5, 30, 20)
    assert run(spark, docs, items, most_bits=64) == sorted(plain(docs, items), key=repr)


def test_hot_passage_and_equal_texts(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    items = [(f"t{k}", f"{passage} own{k}") for k in range(40)] + [("t0", "other text of one item " * 3)]
    docs = [(k, f"pre {passage} post" if k % 3 == 0 else passage if k % 3 == 1 else "clean words only") for k in range(300)]
    assert run(spark, docs, items) == sorted(plain(docs, items), key=repr)


def test_edges(spark):
    items = [("a", "one two three four five six seven eight nine ten eleven"), (None, "alpha beta"), ("n", None), ("e", ""), ("p", "... !"), ("s", "Solo")]
    far = "filler word " * 700_000 + "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "?!"), (None, "x ONE two-three four five six seven eight nine TEN y"), (4, "one two three four five six seven eight nine"), (4, "solo"), (5, "alpha beta"), (6, "solo"), (6, "solo"), (7, far)]
    got = run(spark, docs, items)
    want = sorted(plain(docs[:-1], items) + [(7, 1_400_010, 10, ["a"], [(1_400_000, 1_400_010)])], key=repr)
    assert got == want
    assert run(spark, [], items) == [] and run(spark, docs[:4], []) == sorted(plain(docs[:4], []), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DIR}/benchmark.parquet'").fetchall()
    held = {w for _, t in items for w in zip(*(words(t)[k:] for k in range(10)), strict=False)}
    assert all(len(words(t)) >= 10 for _, t in items)
    want = set()
    for doc, t in docs:
        w = words(t)
        at = [k for k in range(len(w) - 9) if tuple(w[k : k + 10]) in held]
        hit = {p for k in at for p in range(k, k + 10)}
        found = {tuple(w[k : k + 10]) for k in at}
        ids = sorted(str(i) for i, x in items if found & set(zip(*(words(x)[k:] for k in range(10)), strict=False)))
        want.add((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    got = entry.queries()["op13_decontaminate"](spark, DIR).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs) and any(r.contaminated for r in got)
