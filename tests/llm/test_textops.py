"""Word hashes, shingles and majorities against plain versions."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from shelfmark.llm import textops as X

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\té漢-", max_size=30)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words(texts):
    raw = [None if t is None else t.encode() for t in texts]
    for table in (X.PLAIN, X.PLAIN_LOWER, X.ALNUM_LOWER):
        start, end, h, counts = X.hashed_words(raw, table)
        plain = [(t or b"").translate(table).split() for t in raw]
        assert counts.tolist() == [len(p) for p in plain]
        flat = [w for p in plain for w in p]
        joined = b" ".join(t or b"" for t in raw).translate(table)
        assert [joined[a:b] for a, b in zip(start, end, strict=True)] == flat
        same = {}
        for w, x in zip(flat, h.tolist(), strict=True):
            assert same.setdefault(w, x) == x
        assert len(set(same.values())) == len(same)
        sh, at = X.shingles(h, counts, 2)
        want = [w for p in plain for w in zip(p, p[1:], strict=False)]
        assert len(sh) == len(want) and all((sh[i] == sh[j]) == (want[i] == want[j]) for i in range(len(want)) for j in range(i))
        assert (np.diff(at) > 0).all() if len(at) else True


def test_majority_of_very_many():
    rnd = np.random.default_rng(2)
    counts = np.array([0, 1, 2, 0, 200_000, 7, 0])
    h = rnd.integers(0, 1 << 63, counts.sum()).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    want, at = [], 0
    for n in counts:
        bits = np.unpackbits(h[at : at + n].astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0) if n else np.zeros(64)
        want.append(sum(1 << b for b in range(64) if 2 * bits[b] > n))
        at += n
    assert X.majority(h, counts).tolist() == want


def test_chunks_cover_everything():
    rnd = random.Random(1)
    texts = [None if rnd.random() < 0.2 else b"x" * rnd.randrange(50) for _ in range(100)]
    got = list(X.chunks(texts, 60))
    assert [i for a, b in got for i in range(a, b)] == list(range(100)) and list(X.chunks([])) == []
