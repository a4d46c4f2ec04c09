"""Plain versions of the operators, for small tables in memory."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokens(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def line_key(line):
    key = line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    return key if len(key) >= 40 else None


def line_dedup(docs):
    """{doc_id: (n_lines, n_dropped, kept)} of (doc_id, text)."""
    holders = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if (k := line_key(line)) is not None:
                holders[k].add(d)
    out = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not ((k := line_key(x)) is not None and len(holders[k]) >= 5 and max(holders[k]) != d)]
        out[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def quality_counts(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def near_duplicates(docs, width, percent=80):
    """{doc_id: (n_shingles, component_id)}."""
    sets = {d: shingle_set(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target} of {source: size}, by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def sainte_lague(votes, most, house):
    """Seats by highest quotients, ties by name."""
    quotients = sorted((-v / (2 * k - 1), s, k) for s, v in votes.items() for k in range(1, most[s] + 1))
    return Counter(s for _, s, _ in quotients[:house])


def edited_texts(docs):
    """{doc_id: edited text} of distinct ids."""
    ordered = sorted(docs)
    out = {}
    for k, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 4
        out[d] = t[: len(t) - n] + after[:n]
    return out
