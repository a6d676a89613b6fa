"""Counts against a plain reading of their definitions; fences on made-up groups."""

import random
import re
from collections import Counter

from shelfmark.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, counts string"
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "a b c a b c a b",
    "x\x1cy\x85z w",
    "é [tag] <b> #1 100% $5 a|b & *\nline\nline\n \nline",
    "same same same same",
    "\n\na\n\na",
    "long " * 60000 + "\nend",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_counts():
    rnd = random.Random(1)
    more = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(40))) for _ in range(50)]
    got = Q.text_counts([None if t is None else t.encode() for t in TEXTS + more])
    assert [tuple(r[:5]) for r in got] == [plain(t) for t in TEXTS + more]


def corpus():
    rnd = random.Random(2)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(500):
        words = rnd.sample(vocabulary, 80)
        if i % 10 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "hot" if i % 3 else "rare", "own"))
    return [*rows, *[(1000 + i, t, None, None, "own") for i, t in enumerate(TEXTS)], (1, rows[1][1], "en", "hot", "own"), (None, rows[1][1], "en", "hot", "own")]


def test_verdicts_and_stage(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    got = Q.verdicts(df).collect()
    assert len(got) == df.count()
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in got if r.base_failed} == {1000 + i for i in range(len(TEXTS))}
    assert kept == {i for i in range(500) if i % 10} | {None}
    stage = Q.keep_good(df)
    assert stage.columns == df.columns
    assert sorted(map(str, stage.collect())) == sorted(str(r) for r in df.collect() if r.doc_id in kept)


def test_sketches_merge_in_any_order(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    a = sorted(map(str, Q.fences(Q.sketches(Q._plain_counts(df))).collect()))
    b = sorted(map(str, Q.fences(Q.sketches(Q._plain_counts(df.repartition(7)))).collect()))
    assert a == b


def test_quantiles_are_within_a_bucket(spark):
    values = [random.Random(4).lognormvariate(1, 1) for _ in range(2000)]
    df = spark.createDataFrame([(60 + i, int(1e6 * v)) for i, v in enumerate(values)], "i long, v long")
    counts = df.selectExpr("'l' lang", "'s' source", "1000000L n_words", "v word_chars", "v n_symbols", "0L n_dup_lines", "0L n_repeat_words", "1L n_lines")
    row = {r.ratio: r.q for r in Q._quantiles(Q.sketches(counts), "lang").collect()}
    for bucket, i in ((row["mean_word"].b25, 500), (row["mean_word"].b75, 1500), (row["symbols"].upper, 1900)):
        v = int(1e6 * sorted(values)[i - 1]) / 1e6
        assert Q.GAMMA ** (bucket - 1) < v <= Q.GAMMA**bucket * (1 + 1e-12)
    assert row["dup_lines"].upper == Q.ZERO and row["dup_lines"].total == 2000


def test_thresholds_are_each_groups_own(spark):
    """The same text passes among texts like it and goes among others; groups too small for
    a sketch of their own are judged by their language's."""
    rnd = random.Random(6)
    prose = lambda n: [f"word{rnd.randrange(3000)}" for _ in range(n)]
    code = lambda: [w + "$" if rnd.random() < 0.5 else w for w in prose(80)]
    odd = " ".join(w + "$" if i % 2 else w for i, w in enumerate(prose(80)))
    rows = [(i, " ".join(prose(80)), "en", "news") for i in range(200)] + [(200 + i, " ".join(code()), "en", "code") for i in range(200)]
    rows += [(400 + i, " ".join(prose(80)), "de", "news") for i in range(60)]
    rows += [(900, odd, "en", "news"), (901, odd, "en", "code"), (902, odd, "de", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.verdicts(df).collect() if r.kept}
    assert 901 in kept and 900 not in kept and 902 not in kept
    assert all(len(kept & set(range(a, b))) >= 0.9 * (b - a) for a, b in ((0, 200), (200, 400), (400, 460)))


def test_empty(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).limit(0)
    assert Q.verdicts(df).collect() == [] and Q.keep_good(df).collect() == []
