"""Predictions against a plain version, and on held-out texts."""

import random
import zlib
from collections import Counter

from shelfmark.llm import langid as L

SYLLABLES = {"aa": ["the", "ing", "and", "er"], "bb": ["sch", "ung", "der", "ö"], "cc": ["eau", "é", "tion", "le"]}


def corpus():
    rnd = random.Random(8)
    rows = [(0, None, "aa"), (1, "", "bb"), (2, "123 !? \n", "cc"), (3, "ß", None)]
    for i in range(4, 200):
        lang = rnd.choice(sorted(SYLLABLES))
        rows.append((i, " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 60))).title(), lang))
    return [*rows, rows[9], (None, rows[9][1], rows[9][2]), (500, "the ing " * 40000, None)]


def grams(text):
    text = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not text.strip():
        return Counter()
    text = f" {' '.join(text.split())} "
    return Counter(g for n in (1, 2, 3) for i in range(len(text) - n + 1) if (g := text[i : i + n]) != " ")


def number(g):
    out = 0
    for c in g:
        out = out << 21 | ord(c)
    return out


def ranked(counts):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], number(g)))[:400])}


def brute(rows):
    taught = {}
    for d, t, lang in rows:
        if lang is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2):
            taught.setdefault(lang, Counter()).update(grams(t))
    profiles = {k: ranked(c) for k, c in sorted(taught.items())}
    for _, t, _ in rows:
        own = ranked(grams(t))
        if not own:
            yield "und", 0.0
            continue
        far = {k: sum(min(abs(p[g] - i), 400) if g in p else 400 for g, i in own.items()) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        yield best, 1 - far[best] / (400 * len(own))


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = L.identify(df).collect()
    want = sorted((str(d), p, round(s, 9)) for (d, _, _), (p, s) in zip(rows, brute(rows), strict=True))
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got) == want
    truth = {d: lang for d, t, lang in rows if lang and t and t.strip()}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 2]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    profiles = L.train(df)
    blocks = L.predict(df.select("doc_id", "text"), profiles, block=1).collect()
    whole = L.predict(df.select("doc_id", "text"), profiles).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, whole))


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", df.lang.substr(9, 0)).replace("", None, "lang")).collect()} == {"und"}
    assert L.identify(df.limit(0)).collect() == []
