"""Scores against sums over every segmentation, and against plain unigram counts."""

import random
import zlib
from collections import Counter
from math import exp, isclose, log, log10

import pytest
from shelfmark.llm import lattice as L


def corpus():
    rnd = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "Ünïcode 漢字 \x1c▁x <s> 😀"), (4, "A a\x0bA")]
    for i in range(5, 60):
        rows.append((i, " ".join("".join(rnd.choices(["the", "er", "Tion", "é", "q"], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 40)))))
    return [*rows, rows[9], (None, "null the"), (900, "the " * 30000 + "x" * 3000)]


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def test_against_plain_counts(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, score string")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t in rows if not held(d) for w in [*words(t), "</end>"])
    n, v = sum(count.values()), len(count)
    pieces = Counter()
    sp = L._processor(L.default_vocabulary())
    for w, c in count.items():
        if w != "</end>":
            for i in sp.encode(w):
                pieces[i] += c
    lattice = L.Lattice(L.default_vocabulary(), pieces, count["</end>"])
    want = {}
    for d, t in rows:
        tokens = [*words(t), "</end>"]
        want[d] = (held(d), len(tokens), sum(count[w] > 0 for w in tokens), n, sum(log10((count[w] + 1) / (n + v + 1)) for w in tokens), (sum(map(lattice.word, words(t))) + lattice.end) / log(10))
    for size in (None, 500):
        got = L.score(df, bucket_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert isclose(r.base_score, w[4], rel_tol=1e-9) and isclose(r.score, w[5], rel_tol=1e-9)
    assert L.score(df.limit(0)).collect() == []


def every(lattice, s):
    """Sum of the products of all segmentations of s, one by one."""
    if not s:
        return 1.0
    total = exp(sum(lattice.bytes[b] for b in s[0].encode())) * every(lattice, s[1:])
    for i in range(1, len(s) + 1):
        if s[:i] in lattice.pieces:
            total += exp(lattice.pieces[s[:i]]) * every(lattice, s[i:])
    return total


@pytest.mark.parametrize("word", ["", "a", "the", "ertion", "éq", "漢q"])
def test_all_segmentations_count(word):
    lattice = L.Lattice(L.default_vocabulary(), {300: 50, 400: 7, 29900: 20}, 3)
    assert isclose(exp(lattice.word(word)), every(lattice, "▁" + word), rel_tol=1e-9)


def test_pieces_and_end_are_a_distribution():
    lattice = L.Lattice(L.default_vocabulary(), {300: 50, 400: 7}, 3)
    assert isclose(sum(map(exp, [*lattice.pieces.values(), *lattice.bytes, lattice.end])), 1, rel_tol=1e-9)
