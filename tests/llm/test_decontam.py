"""The index against brute force, and removal of what it finds."""

import hashlib
import random
import re

import numpy as np
from shelfmark.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), 10)
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def corpus():
    rnd = random.Random(9)
    v = ["alpha", "Beta", "gamma", "délta", "x1", "the"]
    phrase = lambda n: " ".join(rnd.choice(v) for _ in range(n))
    items = [(i, phrase(rnd.choice([3, 10, 11, 25]))) for i in range(12)] + [(3, phrase(14)), (None, phrase(12)), (40, None), (41, "... !"), (2, "The END: of-it")]
    docs = [(0, None), (1, ""), (2, "!!! \x00"), (3, "the end of it"), (3, "the end of it")]
    for i in range(60):
        t = phrase(rnd.randrange(40))
        if i % 3 == 0:
            t = f"{t}, {rnd.choice(items)[1]}. ({rnd.choice(items)[1]}) zzz {t}"
        docs.append((10 + i, t))
    docs.append((99, "filler " * 30000 + items[0][1] + " filler " + items[1][1]))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str((d, *brute(t, items))) for d, t in docs)
    for size in (1 << 24, 256):  # one block, and several
        got = D.contamination(df, bench, size).drop("spans").collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_suffix_array_and_ranks():
    rnd = np.random.default_rng(1)
    for n, s in ((1, 1), (50, 2), (300, 3), (200, 200)):
        text = rnd.integers(1, s + 1, n)
        assert D.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        m = D.WaveletMatrix(text, s + 1)
        at = np.arange(n)
        assert m.access(at).tolist() == text.tolist()
        assert m.rank(text, at).tolist() == [text[:i].tolist().count(text[i]) for i in range(n)]


def test_removal(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(d, t, len(t or ""), "kept") for d, t in docs], "doc_id long, text string, n_chars long, extra string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.remove_benchmark(df, bench).collect()
    clean = {d for d, t in docs if not brute(t, items)[4]}
    assert {r.doc_id: r.text for r in out if r.doc_id in clean} == {d: t for d, t in docs if d in clean}
    assert all(r.n_chars == len(r.text or "") and r.extra == "kept" for r in out)
    assert not {3} & {r.doc_id for r in out}
    long = next(r for r in out if r.doc_id == 99)
    assert len(words(long.text)) == 30001


def test_empty(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination(df.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in D.contamination(df, bench.limit(0)).collect())
