"""The registered queries over the small tables, against plain versions."""

import math
import os
import random
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest

import __spark_entry__ as entry
from feederflow.llm import quality
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()


def rows(spark, name):
    return entry.queries()[name](spark, DIR).collect()


def test_line_dedup(spark, docs):
    want = {d: (n, k, brute.sha(t)) for d, (n, k, t) in brute.line_dedup(docs).items()}
    got = rows(spark, "op1_line_dedup")
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want and len(got) == len(want)


def test_packing(spark, docs):
    got = rows(spark, "op2_vector_packing")
    ids = {d: x + [1] for (d, _), x in zip(docs, brute.tokens([t for _, t in docs]), strict=True)}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == [4096 * k for k in range(len(parts))]
        assert sum(r.length for r in parts) == len(ids[d])
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(len(x) for x in ids.values())
    assert len(by_bin) <= -(-total // 4096) * 1.02 + 1


def test_source_mix(spark):
    docs = duckdb.sql(f"SELECT doc_id, source, text FROM '{DIR}/documents.parquet'").fetchall()
    size = {d: len(brute.WORD.findall(t or "")) for d, _, t in docs}
    source = {d: s for d, s, _ in docs}
    sizes = Counter()
    for d, s in source.items():
        sizes[s] += size[d]
    goal = brute.mix_targets(sizes)
    got = rows(spark, "op3_source_mix")
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert len(got) == len(docs)
    for s, g in goal.items():
        assert abs(taken[s] - g) <= 64, s
    again = rows(spark, "op3_source_mix")
    assert sorted(got) == sorted(again)


def test_quality_rules(spark, docs):
    good = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, quality FROM '{DIR}/labels.parquet'").fetchall()}
    text = dict(docs)
    got = rows(spark, "op4_quality_rules")
    assert len(got) == len(docs)
    for r in got:
        n, chars, symbols, dup, rep = brute.quality_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
        if not r.base_failed and r.doc_id in good:
            assert r.kept == bool(good[r.doc_id]), r.doc_id


def test_quality_verdicts(spark):
    """The verdicts from exact quantiles; texts within the sketches' error of a fence may differ."""
    table = duckdb.sql(f"SELECT doc_id, lang, source, text FROM '{DIR}/documents.parquet'").fetchall()
    counts = {d: brute.quality_counts(t) for d, _, _, t in table}
    lines = {d: sum(bool(brute.WORD.search(x)) for x in (t or "").split("\n")) for d, _, _, t in table}
    passed = [(d, lang, source) for d, lang, source, _ in table if counts[d][0] >= 50 and 2 * counts[d][4] <= counts[d][0]]
    near, out = set(), {d: [] for d, _, _ in passed}
    for rule in quality.RULES:
        of = {"n_words": 0, "word_chars": 1, "n_symbols": 2, "n_dup_lines": 3, "n_repeat_words": 4}
        value = {d: math.log((counts[d][of[rule.count]] + rule.half) / (lines[d] if rule.per == "n_lines" else counts[d][0])) for d, _, _ in passed}

        def quantiles(keep, value=value, rule=rule):
            own = sorted(value[d] for d, lang, source in passed if keep(lang, source))
            return len(own), [own[max(0, math.ceil(q * len(own) - 1e-9) - 1)] for q in rule.quantiles]

        mixed = lambda n, q, wide: [(n * x + 200 * y) / (n + 200) for x, y in zip(q, wide, strict=True)]
        _, every = quantiles(lambda *_: True)
        for d, lang, source in passed:
            n, q = quantiles(lambda a, b, lang=lang, source=source: (a, b) == (lang, source))
            q = mixed(n, q, mixed(*quantiles(lambda a, _, lang=lang: a == lang), every))
            spread = rule.reach * ((q[2] - q[0]) / 2 if rule.two_sided else q[1] - q[0])
            above = value[d] - (q[0 if not rule.two_sided else 1] + spread)
            below = (q[1] - spread) - value[d] if rule.two_sided else -9.0
            if max(above, below) > 0:
                out[d].append(rule.name)
            if min(abs(above), abs(below)) < (2 * rule.reach + 2) / quality.BUCKETS:
                near.add(d)
    got = {r.doc_id: r for r in rows(spark, "op4_quality_rules")}
    assert len(near) < 0.1 * len(passed) and any(out.values())
    for d in out.keys() - near:
        assert got[d]["broken"] == out[d] and got[d].kept == (not out[d])


def test_minhash(spark, docs):
    want = brute.near_duplicates(docs, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op5_minhash")}
    assert got == want


def test_line_crf(spark):
    good = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DIR}/labels.parquet'").fetchall())
    got = rows(spark, "op6_line_crf")
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    asked = [r for r in got if r.held_out and r.doc_id in good]
    assert asked and sum(r.predicted == good[r.doc_id] for r in asked) >= 0.9 * len(asked)


def test_repair_tokens(spark, docs):
    docs = sorted(docs)
    at, want = 0, {}
    for (d, _), ids in zip(docs, brute.tokens([t for _, t in docs]), strict=True):
        want[d] = (at, len(ids) + 1, brute.crc([*ids, 2]))
        at += len(ids) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op7_repair_tokens")} == want


def test_chat_format(spark):
    chats = defaultdict(list)
    for c, t, r, x in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DIR}/conversations.parquet'").fetchall():
        chats[c].append((t, r, x or ""))
    said = "</s>[INST] ok [/INST]"
    chats[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in rows(spark, "op8_chat_format")}
    assert got.keys() == chats.keys()
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss)) and r.formatted_chars > len(loss)


def test_simhash(spark, docs):
    want = brute.edited_texts(docs)
    text = dict(docs)
    got = rows(spark, "op9_simhash")
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {d: (len(text[d] or ""), brute.sha(t)) for d, t in want.items()}
    prints = {r.doc_id: r.fingerprint for r in got}
    ordered = sorted(prints)
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for r in got:
        after = ordered[(ordered.index(r.doc_id) + 1) % len(ordered)]
        assert r.near_next == 1 - apart(r.fingerprint, prints[after]) / 128
        assert r.near_edited == 1 - apart(r.fingerprint, r.edited_fingerprint) / 128
        if r.doc_id % 20 == 0:
            assert r.n_near == sum(0 < apart(r.fingerprint, p) <= 3 for p in set(prints.values()))
        else:
            assert r.n_near is None
    by_text = defaultdict(set)
    for d, p in prints.items():
        by_text[text[d]].add(p)
    assert all(len(p) == 1 for p in by_text.values())
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)


def test_warc(spark):
    pages = {p: (h or "").encode() for p, h in duckdb.sql(f"SELECT page_id, html FROM '{DIR}/pages.parquet'").fetchall()}
    first = {}
    for p in sorted(pages):
        if len(pages[p]) >= 100:
            first.setdefault(pages[p], p)
    got = {r.page_id: tuple(r)[1:] for r in rows(spark, "op10_warc")}
    for p, h in pages.items():
        other = first.get(h, p)
        assert got[p] == (len(h), brute.sha(h.decode()), "response" if other == p else "revisit", None if other == p else other)
    assert got.keys() == pages.keys()


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    from feederflow.llm import queries

    for name, sql in queries.oracle_sql().items():
        out = con.execute(sql)
        names = [c[0] for c in out.description]
        want = sorted(map(repr, out.fetchall()))
        assert sorted(repr(tuple(r[n] for n in names)) for r in rows(spark, name)) == want


def test_pipeline(spark):
    import corpus_pipeline as cp

    names = [n for n, _ in cp.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "source mix", "packing"]
    base = spark.read.parquet(f"{DIR}/documents.parquet")
    given = {r.doc_id: r for r in base.collect()}
    good = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DIR}/labels.parquet'").fetchall())

    first = cp.quality_stage(spark, base, DIR)
    assert first.columns == base.columns
    kept = {r.doc_id: r for r in first.collect()}
    failed = {d for d, r in given.items() if (c := brute.quality_counts(r.text))[0] < 50 or 2 * c[4] > c[0]}
    assert not failed & kept.keys()
    assert all((d in kept) == bool(good[d]) for d in given.keys() - failed if d in good)

    second = cp.line_stage(spark, first, DIR)
    want = brute.line_dedup([(d, r.text) for d, r in kept.items()])
    lined = {r.doc_id: r for r in second.collect()}
    assert {d: r.text for d, r in lined.items()} == {d: t for d, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for d, r in lined.items() if want[d][1])

    third = cp.near_stage(spark, second, DIR)
    groups = brute.near_duplicates([(d, r.text) for d, r in lined.items()], 5)
    single = {r.doc_id: r for r in third.collect()}
    assert single.keys() == {d for d, (_, root) in groups.items() if d == root}

    fourth = cp.mix_stage(spark, third, DIR)
    assert fourth.columns == base.columns
    sizes, mixed = Counter(), Counter()
    for r in single.values():
        sizes[r.source] += len(brute.WORD.findall(r.text))
    copies = Counter()
    for r in fourth.collect():
        assert single[r.doc_id] == r
        copies[r.doc_id] += 1
        mixed[r.source] += len(brute.WORD.findall(r.text))
    assert max(copies.values()) <= 2
    goal = brute.mix_targets(sizes)
    assert abs(sum(mixed.values()) - sum(goal.values())) < 0.15 * sum(goal.values())

    packed = cp.pack_stage(spark, fourth, DIR).collect()
    ids = dict(zip(single, brute.tokens([r.text for r in single.values()]), strict=True))
    seen = Counter()
    for r in packed:
        assert r.ids_crc32 == brute.crc([*ids[r.doc_id], 1][r.start : r.start + r.length])
        seen[r.doc_id] += r.piece == 0
    assert seen == copies
    assert Counter((r.doc_id, r.piece) for r in packed) == Counter((r.doc_id, r.piece) for r in cp.run(spark, DIR).collect())


def test_random_near_copies(spark):
    """Links between different texts in one large bucket of shared passages, against all pairs."""
    from feederflow.llm.minhash import near_duplicates

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(40)]
    docs, k = [], 0
    for _ in range(60):
        own = common + [word() for _ in range(rng.choice((6, 14, 30)))]
        for _ in range(rng.randint(1, 4)):
            copy = list(own)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((k, " ".join(copy)))
            k += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=width).collect()}
        assert got == brute.near_duplicates(docs, width)
