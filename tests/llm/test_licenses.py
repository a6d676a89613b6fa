"""Notices in known places, whole and slightly edited, against exhaustive containment."""

import random

from shelfmark.llm import licenses as L

NAMES = list(L.TEMPLATES)


def corpus():
    rnd = random.Random(11)
    filler = lambda n: " ".join(f"{rnd.choice('bcdf')}{rnd.randrange(9000)}" for _ in range(n))
    docs, planted = [(0, None), (1, ""), (2, "licensed under"), (3, filler(500))], []
    for i, name in enumerate(NAMES):
        for j in range(4):
            d, at = 10 + 4 * i + j, rnd.randrange(90)
            text = L.TEMPLATES[name]
            if j == 1:
                text = text.upper().replace(" ", "\n* ")
            if j == 2 and len(text.split()) > 40:
                w = text.split()
                w[20] = "changed"
                text = " ".join(w)
            docs.append((d, f"{filler(at)} {text} {filler(60)}"))
            planted.append((d, name, at))
    docs.append((900, filler(60000) + " " + L.TEMPLATES["MIT"]))
    docs += [docs[10], (None, docs[10][1])]
    return docs, planted


def test_planted_notices(spark):
    docs, planted = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, license string")
    got = L.scan(df).collect()
    found = {(r.doc_id, r.license): r for r in got}
    for d, name, at in planted:
        r = found[d, name]
        assert r.start == at and r.containment >= 0.8
    clean = {0, 1, 2, 3}
    assert not clean & {r.doc_id for r in got}
    assert (900, "MIT") in found and (None, found and next(r.license for r in got if r.doc_id is None)) in found
    assert L.scan(df.limit(0)).collect() == []


def test_nothing_but_what_containment_says(spark):
    docs, _ = corpus()
    known = L.Templates(L.TEMPLATES)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in L.scan(df).collect()}
    want = set()
    for d, t in docs:
        w = L.words_of((t or "").encode())
        for name, words, shingles in zip(known.names, known.words, known.shingles, strict=True):
            size = len(words) + len(words) // 4
            grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
            hit = [i for i, g in enumerate(grams) if g in shingles]
            if any(len({grams[j] for j in hit if i <= j <= i + size - 5}) >= 0.8 * len(shingles) for i in hit):
                want.add((d, name))
    assert got == want


def test_texts_that_are_only_a_notice(spark):
    """At every place of the chunk, with few words around, or cut short."""
    docs, want = [], set()
    for i, name in enumerate(NAMES):
        for pad in range(17):
            d = len(docs)
            docs += [(d, " ".join(f"pad{i}x{j}" for j in range(5 + pad))), (d + 1, L.TEMPLATES[name]), (d + 2, f"one {L.TEMPLATES[name]} two")]
            want |= {(d + 1, name), (d + 2, name)}
            if len(L.words_of(L.TEMPLATES[name].encode())) > 60:
                docs.append((d + 3, L.TEMPLATES[name].rsplit(" ", 8)[0]))
                want.add((d + 3, name))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert want <= {(r.doc_id, r.license) for r in L.scan(df).collect()}
