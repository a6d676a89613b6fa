"""Token ids against the tokenizer itself, placement against its definition."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from shelfmark.llm import packing as P
from tokenizers import Tokenizer

ODD = ["a\x0bb\x0cc \x1c d\x85e\xa0f g <|endoftext|>x<|startoftext|>\ty", "Á ́b 'S don't it's,", "\x1cx\x1d y\x1fz", "İstanbul क़ लx. ,a; b:c 12,3. ﬁ", "ÉTÉ. été, ß", "漢字 かな", ".", "a.", "’s"]


def corpus():
    rnd = random.Random(6)
    docs = [(0, None), (1, ""), (2, " \n"), *[(3 + i, t) for i, t in enumerate(ODD)]]
    for i in range(80):
        docs.append((20 + i, " ".join("".join(rnd.choices(["the", "er", "tion", "É", "x,"], k=rnd.randrange(1, 5))) for _ in range(int(rnd.paretovariate(0.7)) % 3000))))
    return [*docs, docs[25], (None, "null id"), (7000, "Word, " * 9000)]


def test_ids_and_placement(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, piece string")
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    want = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            want.append((str(d), p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(np.array(ids[p : p + 4096], "<u4").tobytes())))
    got = P.pack(df, ids=True).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1
    assert P.pack(df.limit(0)).collect() == []


def test_fullest_is_the_fullest():
    rnd = random.Random(1)
    for _ in range(200):
        sizes = [rnd.randrange(1, 20) for _ in range(rnd.randrange(8))]
        room = rnd.randrange(40)
        counts = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
        best = max((sum(c) for k in range(len(sizes) + 1) for c in combinations(sizes, k) if sum(c) <= room), default=0)
        taken = P.fullest(counts, room)
        assert sum(taken) == best and all(taken.count(s) <= n for s, n in counts if s in taken)


def test_patterns_use_every_piece():
    rnd = random.Random(2)
    counts = {rnd.randrange(1, 101): rnd.choice([1, 7, 10**9]) for _ in range(40)}
    used = defaultdict(int)
    for bins, lengths in P.patterns(counts, 100):
        assert sum(s * n for s, n in lengths) <= 100
        for s, n in lengths:
            used[s] += bins * n
    assert used == counts
    assert len(P.patterns(counts, 100)) <= len(counts)
