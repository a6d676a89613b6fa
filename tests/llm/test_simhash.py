"""Fingerprints and classes against brute force, with nulls, ties, repeats and long texts."""

import random

import pytest
import xxhash
from shelfmark.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, rep long"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """{doc_id: least doc_id reachable} by comparing all with all."""
    at = {d: d for d in fps}

    def top(d):
        while at[d] != d:
            d = at[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                at[y] = x
    return {d: top(d) for d in ids}


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One"), (4, "one two"), (5, "one two three"), (6, "ONE two\x0bthree"), (7, "é " * 3)]
    for i in range(60):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 300]))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rnd.choice([0, 0, 1, 4])):
            text = list(text)
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((len(rows), "\n".join(text)))
    rows.append((len(rows), "long " * 70000 + "tail"))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], SCHEMA)
    got = {r.doc_id: r for r in S.near_duplicate_classes(df).collect()}
    fps = {d: fingerprint(t) for d, t in rows}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{x:016x}" for d, x in fps.items()}
    assert {d: r.component_id for d, r in got.items()} == classes(fps)


@pytest.mark.parametrize("window", [2, 4])
def test_full_cells_lose_no_link(spark, window):
    """Cells of over `window` rows take the linear way and give the same classes."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = {}
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(64)
            fps[x] = fps.get(x, len(fps))
    nodes = spark.createDataFrame([(S._signed(x), d) for x, d in fps.items()], "fp long, rep long")
    got = {r.node: r.component for r in S.components(S.links(nodes, window)).collect()}
    want = classes({d: x for x, d in fps.items()})
    assert {d: got.get(d, d) for d in want} == want


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in S.near_duplicate_classes(df).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert S.near_duplicate_classes(df.limit(0)).collect() == []


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_duplicates_by_five_words(spark):
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, kin = [], []
    for i in range(60):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([40, 200, 900]))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rnd.choice([0, 2, 3])):
            copy = list(text)
            for _ in range(max(1, len(text) // 200)):
                copy[rnd.randrange(len(copy))] = "Edited"
            kin.append((rows[-1][0], len(rows), jaccard(" ".join(text), " ".join(copy))))
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_chars long")
    at = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    close = [(a, b) for a, b, j in kin if j >= 0.87]
    assert len(close) > 30 and sum(at[a] == at[b] for a, b in close) >= 0.97 * len(close)
    group = {}
    for a, b, _ in kin:
        group[b] = group.setdefault(a, a)
    assert all(group.get(d, d) == group.get(c, c) for d, c in at.items())
    out = S.keep_one(df).collect()
    assert sorted(r.doc_id for r in out) == sorted(set(at.values()))


def test_keep_one_nulls_short_repeats(spark):
    rows = [(5, "a b"), (4, "A  b"), (3, "b a"), (2, None), (1, ""), (None, "a b"), (None, "z z z z z z"), (6, "only"), (6, "only"), (7, "x " * 40000), (8, "X " * 40000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    out = S.keep_one(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "6", "7", "None", "None"]
    assert S.keep_one(df.limit(0)).collect() == []


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rows = [(9, "one two three four five six", 1), (9, "quite another text of some words", 2), (9, "quite another text of some words", 3), (10, "quite another text of some words", 0), (11, "One two three four five six", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep int")
    want = [(9, rows[0][1], 1), (9, rows[1][1], 2)]
    for order in (df, df.orderBy(S.F.desc("keep"))):
        assert sorted(tuple(r) for r in S.keep_one(order).collect()) == want


def test_full_cells_of_near_copies_hold_together(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(5000)}" for _ in range(600)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rnd.randrange(600)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in S.near_duplicates(df, window=8).collect()} == {0}


def groups(n, pairs):
    return S._hang(S.np.arange(n), *(S.np.array(p) for p in zip(*pairs, strict=True))).tolist()


@pytest.mark.parametrize("block", [S.BLOCK, 200])
def test_hot_source_loses_no_near_copy(spark, block):
    """Fingerprints some 54 bits apart fill cells; a near copy with another first bit lies
    far off in sorted order."""
    rnd = random.Random(3)
    base, rows, kin = rnd.getrandbits(256), [], []
    for i in range(1500):
        x = base ^ sum(1 << b for b in rnd.sample(range(255), 30))
        rows.append(x)
        if i % 10 == 0:
            rows.append(x ^ (1 << 255) ^ sum(1 << b for b in rnd.sample(range(255), 9)))
            kin.append((len(rows) - 2, len(rows) - 1))
    cut = lambda x: [S._signed(x >> 64 * (3 - i) & (1 << 64) - 1) for i in range(4)]
    df = spark.createDataFrame([(*cut(x), d) for d, x in enumerate(rows)], "f0 long, f1 long, f2 long, f3 long, rep long")
    found = {(r.a, r.b) for r in S.wide_links(df, 38, 2, block).collect()}
    near = {(a, b) for b, y in enumerate(rows) for a, x in enumerate(rows[:b]) if (x ^ y).bit_count() <= 38}
    assert len(near) >= len(kin) and found <= near
    got = groups(len(rows), found)
    assert all(got[a] == got[b] for a, b in kin) and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)


def test_candidates_hang_together_what_all_pairs_do():
    rnd = random.Random(2)
    for n in (4, 9, 40):
        pairs = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(2 * n)})
        apart = [rnd.randrange(5) for _ in pairs]
        left, right, d = S.candidates(n, tuple(S.np.array(x) for x in (*zip(*pairs, strict=True), apart)))
        kept = set(zip(left.tolist(), right.tolist(), strict=True))
        assert groups(n, kept) == groups(n, pairs) and (n > S.FEW or len(kept) == len(pairs))
        for most in range(5):  # at every distance
            under = [p for p, a in zip(pairs, apart, strict=True) if a <= most]
            mine = [p for p, a in zip(zip(left.tolist(), right.tolist(), strict=True), d.tolist(), strict=True) if a <= most]
            assert not under or groups(n, mine) == groups(n, under)


def test_recall_and_precision_by_similarity(spark):
    """Against all pairs, with a hot source of templated texts that are alike but mostly not
    near copies, so that cells hold far more than WINDOW rows."""
    rnd = random.Random(31)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    template = [rnd.choice(vocabulary) for _ in range(240)]
    for i in range(500):
        texts.append([*template[:200], *(rnd.choice(vocabulary) for _ in range(70)), *template[200:]])
    for i in range(500):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([60, 150, 400]))]
        if i % 5 == 0:
            base = list(texts[i])
        texts.append(base)
        for share in (0.004, 0.012, 0.019, 0.03):
            copy = list(base)
            for _ in range(max(1, round(share * len(base)))):
                copy[rnd.randrange(len(copy))] = f"edited{rnd.randrange(10**6)}"
            texts.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    both = S.np.zeros((len(sets), len(sets)), S.np.int16)
    for h in holders.values():
        if len(h) > 1:
            both[S.np.ix_(h, h)] += 1
    size = S.np.array(list(map(len, sets)))
    j = both / (size[:, None] + size[None, :] - both)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    at = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    got = S.np.array([at[d] for d in range(len(texts))])
    same = got[:, None] == got[None, :]
    upper = S.np.triu(S.np.ones_like(same), 1)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        pairs = upper & (j >= low) & (j < high)
        assert pairs.sum() > 100 and (same & pairs).sum() >= 0.9 * pairs.sum(), (low, (same & pairs).sum(), pairs.sum())
    true = S.np.array(groups(len(texts), list(zip(*S.np.nonzero(upper & (j >= 0.8)), strict=True))))
    assert not (same & (true[:, None] != true[None, :])).any()


@pytest.mark.parametrize("bits", [16, 17, 19, 24])
def test_grids_meet_at_the_radius(bits):
    grids = [[b for i, m in enumerate(g[1:]) for b in range(64) if m >> b & 1 for b in [64 * i + b]] for g in S._sampled_grids(bits)]
    rnd = random.Random(bits)
    met = 0
    for _ in range(400):
        apart = set(rnd.sample(range(256), S.MEETS))
        met += any(apart.isdisjoint(g) for g in grids)
    assert met >= 0.97 * 400


@pytest.mark.parametrize(("window", "block"), [(64, 16384), (4, 16384), (4, 24)])
def test_every_pair_that_meets_is_in_one_class_or_verified(spark, window, block):
    """Texts that are alike, most under 0.8: chains of near fingerprints fail to verify, and
    pairs farther apart do not.  Against every pair that meets in a grid."""
    rnd = random.Random(24)
    long, edits, radius = rnd.choice([9, 12, 16, 24]), rnd.choice([1, 2, 3]), rnd.choice([100, 140, 256])
    rows = []
    for _ in range(120):
        w = [f"w{j}" for j in range(long)]
        for _ in range(rnd.randrange(0, edits + 1)):
            w[rnd.choice([0, 1, long - 1, long - 2, rnd.randrange(long)])] = f"x{rnd.randrange(9)}"
        rows.append(" ".join(w[rnd.randrange(3) :]))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    fps = {r.doc_id: tuple(r[f"f{i}"] & (1 << 64) - 1 for i in range(4)) for r in S.wide_fingerprints(df).collect()}
    least = {f: d for d, f in sorted(fps.items(), reverse=True)}
    grids = [[m & (1 << 64) - 1 for m in g[1:]] for g in S._sampled_grids(16)]
    links = {(least[f], d) for d, f in fps.items()}
    for b in least.values():
        for a in (d for d in least.values() if d < b):
            apart = [x ^ y for x, y in zip(fps[a], fps[b], strict=True)]
            meet = any(not any(x & m for x, m in zip(apart, g, strict=True)) for g in grids)
            if meet and sum(x.bit_count() for x in apart) <= radius and jaccard(rows[a], rows[b]) >= 0.8:
                links.add((a, b))
    want = groups(120, links)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df, radius=radius, window=window, block=block).collect()}
    assert [got[i] for i in range(120)] == want


def test_texts_that_are_alike_make_no_row_for_each_pair(spark):
    """150 texts with half their words in common, and two near copies that no candidate
    links: one link comes out of the step that looks at all pairs, not the 22,600 pairs."""
    rnd = random.Random(27)
    base = [f"w{i}" for i in range(120)]
    rows = [" ".join(base[:60] + [f"x{rnd.randrange(10**6)}" for _ in range(60)]) for _ in range(150)]
    rows[140] = rows[3] + " more"
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    fps = S.wide_fingerprints(df).collect()
    nodes = spark.createDataFrame([(r.doc_id, r.doc_id, r.version, r.f0, r.f1, r.f2, r.f3) for r in fps], "rep long, doc_id long, version long, f0 long, f1 long, f2 long, f3 long")
    star = spark.createDataFrame([(0, i) for i in range(1, 150)], "a long, b long")
    rest = spark.createDataFrame([(g, i) for g in range(3) for i in range(150)], "group long, rep long")
    none = spark.createDataFrame([], "node long, component long")
    grids = [(0, 0, 0, 0, 0)]
    for most in (1024, 40):
        made = S.joining(nodes, rest, none, star, S.shingle_sets(df, nodes, star), grids, 0.8, 256, most)
        assert [tuple(r) for r in made.collect()] == [(3, 140)]
    copies = spark.createDataFrame([(i, rows[0] + f" own{i}") for i in range(150)], "doc_id long, text string")
    known = S.shingle_sets(copies, S._keyed(copies).select(S.F.col("doc_id").alias("rep"), "doc_id", "version"), star)
    made = [(r.a, r.b) for r in S.joining(nodes, rest, none, star, known, grids, 0.8, 256).collect()]
    assert set(groups(150, made)) == {0} and len(made) < 600


@pytest.mark.parametrize("cell", [64, 4])
def test_no_link_is_lost(spark, monkeypatch, cell):
    """Short texts at 0.8 and somewhat above: many differ in over RADIUS bits or meet in no
    grid.  Classes are those of all pairs, by brute force; some texts are in a hot group."""
    monkeypatch.setattr(S.completed, "__defaults__", (*S.completed.__defaults__[:-1], cell))
    rnd = random.Random(51)
    rows = []
    for i in range(200):
        more = rnd.choice([2, 3, 5, 8])
        base = [f"w{rnd.randrange(3000)}" for _ in range(4 * more + 4)]
        if i % 8 == 0:
            base[more:] = [f"line{j}" for j in range(len(base) - more)]
        rows += [" ".join(base), " ".join([*base, *(f"x{i}.{j}" for j in range(more - i % 2))])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    links = [(a, b) for b in range(len(rows)) for a in range(b) if jaccard(rows[a], rows[b]) >= 0.8]
    fps = {r.doc_id: tuple(r[f"f{i}"] for i in range(4)) for r in S.wide_fingerprints(df).collect()}
    apart = [sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(fps[a], fps[b], strict=True)) for a, b in links]
    assert sum(x > S.RADIUS for x in apart) > 5
    assert len(links) > 150
    want = groups(len(rows), links)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == sorted(set(want))
