"""Nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from feederflow.llm import chat, line_crf, line_dedup, minhash, mixing, packing, quality, repair, simhash, warc
from feederflow.llm.shared import shared_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LINE = "the same line of more than forty characters in all of them"
ROWS = [(k, LINE + f"\nown {k}", "en", None if k % 2 else "s", 1) for k in range(6)] + [(6, None, None, None, None), (7, "", "en", "s", 0), (None, LINE, "en", "s", 9), (0, LINE + "\nown 0", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_lines long")


@pytest.fixture(params=[False, True], ids=["rows", "empty"])
def table(request, docs):
    return docs.limit(0) if request.param else docs


def test_documents(spark, docs, table):
    n = table.count()
    lined = line_dedup.line_dedup(table).collect()
    assert len(lined) == n
    if n:
        kept = {r.doc_id: r for r in lined}
        assert kept[5].n_dropped == 0 and kept[0].kept_text == "own 0" and kept[6].n_lines == 1 and kept[None].kept_text == LINE
    assert packing.pack(table, VOCABULARY).count() == n
    mixed = mixing.mix_sources(table).collect()
    assert len(mixed) == n and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    assert quality.quality_rules(table).where("kept").count() == 0 and quality.quality_rules(table).count() == n
    near = minhash.near_duplicates(table, width=2).collect()
    assert len(near) == n and all(r.kept for r in near if r.doc_id is None or r.doc_id > 5)
    model = line_crf.train(table, spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in line_crf.score_quality(table, model).collect())
    prints = simhash.count_near(simhash.neighbour_fingerprints(table)).collect()
    assert len(prints) == n and len({r.fingerprint for r in prints if r.doc_id == 0}) <= 1
    path = shared_path(spark, "edge")
    repair.write_tokens(table, path, VOCABULARY)
    assert repair.read_tokens(spark, path).count() == n


@pytest.mark.parametrize("least", [50, 0])
def test_texts_without_words_beside_fences(spark, least):
    """Null, empty and blank texts in a group that has fences, and whose verdicts are read; with ``least`` 0 they pass the base rules."""
    body = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{body} {k}") for k in range(5)] + [(5, None), (6, ""), (7, " \n\t\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r.doc_id: r for r in quality.quality_rules(df, least_words=least).collect()}
    assert [got[k].kept for k in range(8)] == [True] * 5 + [least == 0] * 3
    assert all(got[k].n_words == 0 and got[k].broken == [] for k in (5, 6, 7))


def test_chats(spark):
    rows = [(1, 2, "user", "b & <s>"), (1, 1, "user", "a [/INST]"), (1, 3, None, None), (1, 3, "assistant", "x"), (None, None, "assistant", ""), (1, 1, "user", "a [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("pieces", F.lit(1))
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a [/INST]"), ("user", "a [/INST]"), ("user", "b & <s>"), ("", ""), ("assistant", "x")]
    assert got[1].loss_text == "x" and [tuple(t) for t in got[None].turns] == [("assistant", "")]
    assert chat.parse_chats(chat.format_chats(df.limit(0))).count() == 0


def test_warc(spark):
    long = "é" * 30_000
    rows = [(3, "http://a b\r\n", long), (2, None, long), (2, None, long), (4, "u", None), (5, "u", "WARC/1.1\r\n\r\n" * 900), (None, "u", "y" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("z"))
    runs = []
    for most in (1 << 18, 0):
        path = shared_path(spark, "edge-warc")
        warc.write_warc(df, path, max_copies=most)
        runs.append(sorted((str(r.page_id), r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_warc(spark, path).collect()))
    assert runs[0] == runs[1] == [("2", "response", 60_000, None), ("2", "response", 60_000, None), ("3", "revisit", 60_000, 2), ("4", "response", 0, None), ("5", "response", 10_800, None), ("None", "response", 200, None)]
    path = shared_path(spark, "edge-warc")
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_shard_ranges():
    import numpy as np

    ids = np.random.default_rng(1).integers(0, 50, 30_000).astype(np.uint32)
    shard = repair.Shard(repair.write_shard(ids, [1, None], np.array([10_000, 20_000]), 4))
    assert (shard.all() == ids).all() and len(shard.rules) and shard.doc_ids == [1, None]
    for start, n in ((0, 1), (9_999, 2_000), (29_000, 1_000), (5, 0), (0, 30_000)):
        assert (shard.range(start, n) == ids[start : start + n]).all()


def test_near_links(spark):
    """Every pair within the radius, equal fingerprints too, against all pairs."""
    import random

    rng, prints = random.Random(3), []
    for _ in range(40):
        own = rng.getrandbits(128)
        prints += [own, own] + [own ^ sum(1 << b for b in rng.sample(range(128), n)) for n in (1, 3, 4, 8, 14, 15, 16, 20)]
    prints += [0, (1 << 128) - 1, (1 << 15) - 1]
    docs = spark.createDataFrame([(k, f"{p:032x}") for k, p in enumerate(prints)] + [(None, f"{prints[0]:032x}"), (1000, None)], "doc_id long, fingerprint string")
    links, members = simhash.near_links(docs, every=5)
    apart = lambda a, b: (a ^ b).bit_count()
    asked = range(0, len(prints), 5)
    want = sorted((k, f"{p:032x}", apart(prints[k], p)) for k in asked for p in set(prints) if apart(prints[k], p) <= 15)
    assert sorted(map(tuple, links.collect())) == want
    assert members.count() == docs.count()
    got = {r.doc_id: (r.n_near, r.n_links) for r in simhash.count_near(docs, every=5).collect() if r.doc_id is not None}
    for k, p in enumerate(prints):
        near = sum(0 < apart(p, x) <= 3 for x in set(prints))
        links = sum(apart(p, x) <= 15 for x in [*prints, prints[0]]) - 1
        assert got[k] == ((near, links) if k % 5 == 0 else (None, None))
    assert got[1000] == (0, 0)


def test_numbers_of_blocks_agree(spark):
    import random

    rng = random.Random(9)
    prints = [rng.getrandbits(128) for _ in range(12)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), n)) for p in prints[:6] for n in (2, 9, 15, 16)]
    all_of = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    asked = all_of.limit(6)
    want = sorted((f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in prints[:6] for b in set(prints) if (a ^ b).bit_count() <= 15)
    for blocks in (None, 4, 8, 16):
        assert sorted(map(tuple, simhash.within_radius(asked, all_of, 15, blocks).collect())) == want


def test_probes_of_fingerprints_are_not_broadcast(spark):
    """A fingerprint is 136 rows of the join, more than the sizes that Spark goes by say."""
    prints = spark.range(400).select(F.md5(F.col("id").cast("string")).alias("fingerprint"))
    found = simhash.within_radius(prints.where("fingerprint < '4'"), prints, 15, 8)
    assert found.where("distance = 0").count() == prints.where("fingerprint < '4'").count()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan



def test_fingerprints_by_plain_votes():
    """Each bit of each term's 128 votes for or against it, windows of two words four times as much as words."""
    import numpy as np
    import pyarrow as pa

    from feederflow.llm.shared import Words, mix, shingles

    texts = ["", "one", "One two one two THREE", " a\tb  a b c ", "x " * 70_000 + "y"]
    got = simhash.fingerprints(pa.array(texts))
    for k, t in enumerate(texts):
        own, votes = Words(pa.array([t]), lower=True), [0] * 128
        for hashes, weight in ((shingles(own, 2)[0], 4), (own.hashes(), 1)):
            terms, counts = np.unique(hashes, return_counts=True)
            for h, n in zip(terms, counts.tolist(), strict=True):
                for word in range(2):
                    bits = int(mix(np.array([h], np.uint64) + np.uint64((word + 1) * 0x9E3779B97F4A7C15 % 2**64))[0])
                    # bytes from the lowest on, the highest bit of each first
                    for b in range(64):
                        votes[64 * word + b] += weight * n * (1 if bits >> (8 * (b // 8) + 7 - b % 8) & 1 else -1)
        plain = [sum((votes[64 * w + b] > 0) << (63 - b) for b in range(64)) for w in range(2)]
        assert got[k].tolist() == plain, t[:20]


def test_texts_that_differ_in_case_or_by_a_word_are_linked(spark):
    words = [f"w{k % 97}x{k * k % 61}" for k in range(300)]
    other = ["new" if k == 150 else w for k, w in enumerate(words)]
    rows = [(0, " ".join(words)), (1, " ".join(words).upper()), (2, " ".join(other)), (3, " ".join(f"z{k}" for k in range(300)))]
    got = simhash.count_near(simhash.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.n_links for r in got} == {0: 2, 1: None, 2: None, 3: None}


def test_repair_replaces_all_frequent_pairs():
    """A copied passage ends as one symbol a copy, and no pair is left that occurs three times."""
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(2)
    passage = rng.permutation(2_000)[:500]
    ids = np.concatenate([np.concatenate((passage, [3_000 + k])) for k in range(1_000)]).astype(np.uint32)
    shard = repair.Shard(repair.write_shard(ids, [1], np.array([len(ids)])))
    assert (shard.all() == ids).all() and len(shard.seq) <= 2_000
    ids = np.concatenate((rng.integers(0, 300, 50_000), [5] * 1_001, [7])).astype(np.uint32)
    data = repair.write_shard(ids, [1], np.array([len(ids)]))
    shard = repair.Shard(data)
    assert (shard.all() == ids).all() and len(data) < 2 * len(ids)
    assert (shard.range(49_990, 1_012) == ids[49_990:]).all()
    pairs = Counter((a, b) for a, b in zip(shard.seq[:-1].tolist(), shard.seq[1:].tolist(), strict=True) if a != b)
    assert max(pairs.values()) < 3


def test_warc_payloads(spark):
    """Whole, cut and empty pages come back with their bytes; only revisits hold none."""
    html = {1: "<p>short</p>", 2: "é" * 30_000, 3: "", 4: "x" * 200, 5: "x" * 200}
    path = shared_path(spark, "edge-warc")
    warc.write_warc(spark.createDataFrame([(k, f"http://{k}", h) for k, h in html.items()], "page_id long, url string, html string"), path)
    got = {r.page_id: None if r.payload is None else bytes(r.payload) for r in warc.read_warc(spark, path).collect()}
    assert got == {k: None if k == 5 else h.encode() for k, h in html.items()}
