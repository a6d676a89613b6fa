"""SimHash fingerprints, and links between those that differ in few bits.

A fingerprint is mapped to the bit counts of its segments.  Two fingerprints that
differ in r bits have count vectors at a Manhattan distance of r at most, so a range
join on the counts loses no link.  The join deals fingerprints into grid cells:
segments of two bits form six groups of coordinates.  Vectors at a Manhattan distance of
two differ in two coordinates at most, so in two groups at most: the range join at this
radius is an equality join on four groups, once for each choice of four.  A grid is such
a choice, its cells being the counts of these groups.  In a cell the Manhattan distance
on all coordinates is tested first, then the bits.

A cell of over WINDOW fingerprints is not compared all with all.  Its members go to an
exact linear way: each sends itself and its 64 neighbours at one bit; any two that send
a common value differ in two bits at most, and any two that differ in two bits at most
send a common value, so hanging all senders of a value on the least of them gives the
same components as all links would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .graph import components

#: Fingerprints of one grid cell that are compared all with all.
WINDOW = 64
_FIVES = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _xxh64_of_shingles(text: bytes, k: int) -> bytes:
    """Big-endian XXH64 digests (seed 42) of the text's k-word shingles."""
    words = text.lower().split()
    if not words:
        return b""
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= k:
        return digest(line, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return b"".join([digest(line[a:b], 42) for a, b in zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every document: a bit of fp is 1 if it is in over half of the
    XXH64 hashes of the lower-cased text's word shingles.  Fewer words than a shingle
    make one; a null text, or one without words, has fingerprint 0."""
    X.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = X.as_bytes(batch.column("text"))
            out = []
            for a, b in X.chunks(texts, 4 << 20):
                parts = [_xxh64_of_shingles(t or b"", words) for t in texts[a:b]]
                counts = np.fromiter((len(p) // 8 for p in parts), np.int64, len(parts))
                out.append(X.majority(np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), counts))
            fp = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(X.tidy(run), "doc_id long, fp long")


def segment_counts(fp: F.Column) -> F.Column:
    """Bit counts of the 32 segments of two bits, each in its segment's place."""
    low, high = fp.bitwiseAND(F.lit(_FIVES)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_FIVES))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _grid_masks(groups: int, equal: int) -> list[int]:
    """For each choice of groups that agree, the bits of their segments."""
    edge = [round(32 * i / groups) for i in range(groups + 1)]
    mask = [sum(3 << 2 * s for s in range(edge[i], edge[i + 1])) for i in range(groups)]
    return [reduce(int.__or__, (mask[i] for i in c)) for c in combinations(range(groups), equal)]


def _embedded(fp: np.ndarray) -> np.ndarray:
    """segment_counts() of an array."""
    low, high = fp & np.uint64(_FIVES), (fp >> np.uint64(1)) & np.uint64(_FIVES)
    return ((low & high) << np.uint64(1)) | (low ^ high)


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Manhattan distance of segment counts.  Counts are 0 to 2, so two of them differ
    by two where their bits differ in the higher one alone."""
    t = x ^ y
    return np.bitwise_count(t & np.uint64(_FIVES)) + 2 * np.bitwise_count((t >> np.uint64(1)) & ~t & np.uint64(_FIVES))


def compare_cells(batches: Iterator[pa.RecordBatch], bits: list[str], cell: list[str], node: str, radius: int, window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell.  Compares every two rows of a cell that are under window
    places apart; of those that differ in at most radius bits, gives links (a, b) that
    hang together what they hang together, each group on its least node.  Also gives
    (a, null) for every row of a cell with over window rows.  Only the last window rows are
    kept between batches."""
    kept: pa.Table | None = None
    rank0 = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        old = 0
        if kept is not None:
            old = kept.num_rows
            table = pa.concat_tables([kept, table])
        n = table.num_rows
        keys = [np.asarray(table.column(c)) for c in cell]
        fp = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in bits], axis=1).view(np.uint64)
        who = np.asarray(table.column(node))
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        rank = np.arange(n) - first[run]
        rank[run == 0] += rank0
        big = np.zeros(len(first), bool)
        big[run[rank >= window]] = True
        a, b = [], []
        counts = _embedded(fp)
        for d in range(1, min(window, n)):
            right = np.arange(max(old, d), n)
            right = right[rank[right] >= d]
            if not len(right):
                break
            left = right - d
            near = _manhattan(counts[left], counts[right]).sum(1) <= radius
            left, right = left[near], right[near]
            exact = np.bitwise_count(fp[left] ^ fp[right]).sum(1) <= radius
            a.append(left[exact])
            b.append(right[exact])
        left, right = (np.concatenate([*x, []]).astype(np.int64) for x in (a, b))
        top = who.copy()
        while len(left):
            least = np.minimum(top[left], top[right])
            if (top[left] == least).all() and (top[right] == least).all():
                break
            np.minimum.at(top, left, least)
            np.minimum.at(top, right, least)
        hung = np.flatnonzero(top != who)
        hot = who[big[run]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([top[hung], hot]).astype(np.int64)), pa.array(np.concatenate([who[hung], hot]).astype(np.int64), mask=np.arange(len(hung) + len(hot)) >= len(hung))], names=["a", "b"])
        keep = min(window, int(rank[-1]) + 1, n)
        rank0 = int(rank[-1]) + 1 - keep
        kept = table.slice(n - keep)


def links(nodes: DataFrame, window: int = WINDOW) -> DataFrame:
    """nodes: (fp, rep), fp unique.  Links (a, b) of reps whose components are those of
    all fingerprints at two or fewer differing bits."""
    spark = nodes.sparkSession
    n = spark.conf.get("spark.sql.shuffle.partitions")
    count = segment_counts(F.col("fp"))
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), count.bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(_grid_masks(6, 4))])
    dealt = nodes.select("fp", "rep", F.explode(grids).alias("k")).select("fp", "rep", "k.grid", "k.cell").repartition(int(n), "grid", "cell").sortWithinPartitions("grid", "cell", "fp")
    found = X.written(dealt.mapInArrow(X.tidy(lambda it: compare_cells(it, ["fp"], ["grid", "cell"], "rep", 2, window)), "a long, b long"), "simhash-links")
    near = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("rep")).distinct().join(nodes, "rep")
    if found.where("b is null").isEmpty():
        return near.distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    sent = hot.select("rep", F.explode(flips).alias("z"))
    least = sent.groupBy("z").agg(F.min("rep").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    stars = sent.join(least, "z").where("rep != m").select(F.col("m").alias("a"), F.col("rep").alias("b"))
    return near.unionByName(stars).distinct()


def near_duplicate_classes(docs: DataFrame, words: int = 3, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the least doc_id reached over links of at most two differing bits.
    Equal texts, and all texts without words (fingerprint 0), share a fingerprint and so
    a component.  Repeated rows come back as often as they came; a null doc_id is never
    a component's id, so a component of null ids alone has a null id.  Other columns are
    ignored; an empty table gives no rows.
    """
    fps = X.written(fingerprints(docs, words), "fingerprints")
    nodes = X.written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    found = components(links(nodes.where("rep is not null"), window))
    classes = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The wide fingerprint of near_duplicates(): words of 64 bits, words in a shingle, and
#: the least Jaccard similarity of near duplicates.  Sets with a similarity of J differ in
#: about 256 * acos(2J / (1 + J)) / pi bits: 39 at 0.8, with a standard deviation of 6.
LANES, SHINGLE, SIMILARITY = 4, 5, 0.8
#: Differing bits up to which shingles are compared (19 of 20 pairs at 0.8 are within), and
#: those up to which there is hardly any pair under 0.8.
RADIUS, SURE = 48, 20
#: Grids are drawn until fingerprints at MEETS differing bits, the usual number at a
#: similarity of 0.8, meet in one with a chance of MEETING.
MEETS, MEETING = 38, 0.99
#: Rows of a wide cell that one task compares all with all, and rows hanging together in a
#: cell up to which all their pairs are candidates (beyond, those of a spanning forest).
BLOCK, FEW = 16384, 8
_F = [f"f{i}" for i in range(LANES)]


def _sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number for each text) of five-word shingles of the lower-cased texts; fewer
    words make one, no words none."""
    _, _, h, counts = X.hashed_words(texts, X.PLAIN_LOWER)
    sh, at = X.shingles(h, counts, SHINGLE)
    n = np.bincount(np.repeat(np.arange(len(texts)), counts)[at], minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (n == 0))
    if len(short):
        first = np.cumsum(counts) - counts
        one = np.array([X.mix(np.array([int(sum((i + 1) * int(x) for i, x in enumerate(h[first[i] : first[i] + counts[i]]))) % (1 << 64)], np.uint64))[0] for i in short], np.uint64)
        sh = np.insert(sh, (np.cumsum(n) - n)[short], one)
        n[short] = 1
    return sh, n


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): version tells apart texts that share a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, f0..f3): 256 bits, each 1 if in over half of the hashes of the
    text's shingles (no words: all zero)."""
    X.bounded_batches(docs.sparkSession)
    lanes = X.mix(np.arange(11, 11 + LANES, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = X.as_bytes(batch.column("text"))
            out = [np.zeros((0, LANES), np.uint64)]
            for a, b in X.chunks(texts):
                sh, n = _sets(texts[a:b])
                out.append(np.stack([X.majority(X.mix(sh ^ lane), n) for lane in lanes], axis=1))
            f = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *(pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in range(LANES))], names=["doc_id", "version", *_F])

    return _keyed(docs).mapInArrow(X.tidy(run), "doc_id long, version long, " + ", ".join(f"{c} long" for c in _F))


def _sampled_grids(bits: int) -> list[tuple[int, ...]]:
    """Grids of so many one-bit segments each, as a mask for each lane: as many as two
    fingerprints at MEETS bits need to meet in one with a chance of MEETING."""
    meet = math.prod(max(0, 64 * LANES - MEETS - i) / (64 * LANES - i) for i in range(bits))
    rnd = np.random.default_rng(20)
    out = []
    for g in range(math.ceil(math.log(1 - MEETING) / math.log1p(-min(meet, MEETING)))):
        mask = [0] * LANES
        for i in rnd.choice(64 * LANES, bits, replace=False).tolist():
            mask[i // 64] |= 1 << i % 64
        out.append((g, *map(_signed, mask)))
    return out


def _hang(top: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """top, the first place of every place's group, with the groups of left and right joined."""
    a, b = top[left], top[right]
    on = np.arange(len(top))
    while True:
        low = np.minimum(on[a], on[b])
        if (on[a] == low).all() and (on[b] == low).all():
            return on[top]
        np.minimum.at(on, a, low)
        np.minimum.at(on, b, low)


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]
_NONE: Pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def candidates(n: int, pairs: Pairs) -> Pairs:
    """Those of the pairs (left, right, distance) of n places to be verified.  Of places that
    hang together by pairs, up to FEW keep all pairs; more keep a minimum spanning forest,
    in which any two meet over steps no longer than their own distance."""
    order = np.lexsort((pairs[1], pairs[0], pairs[2]))
    left, right, apart = (x[order] for x in pairs)
    top, taken, live = np.arange(n), np.zeros(len(left), bool), np.arange(len(left))
    while len(live):
        a, b = top[left[live]], top[right[live]]
        cross = a != b
        live, a, b = live[cross], a[cross], b[cross]
        if not len(live):
            break
        best = np.full(n, len(left))
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        new = np.unique(best[best < len(left)])
        taken[new] = True
        top = _hang(top, left[new], right[new])
    taken |= np.bincount(top, minlength=n)[top][left] <= FEW
    return left[taken], right[taken], apart[taken]


def _all_pairs(fp: np.ndarray, top: np.ndarray, radius: int, split: int | None = None) -> Pairs:
    """candidates() of all pairs of rows, or of those of one row before split and one from
    it on.  top has groups of rows that surely hang together; their pairs are not looked
    at, nor those of groups that are found on the way."""
    n = len(fp)
    order = np.lexsort((top, -np.bincount(top, minlength=n)[top]))
    rows, cols = (order, order) if split is None else (order[order < split], order[order >= split])
    lanes = [np.ascontiguousarray(fp[:, i]) for i in range(fp.shape[1])]
    tall, wide, held = 128, 1024, [_NONE]
    for i in range(0, len(rows), tall):
        r = rows[i : i + tall]
        for j in range(i if split is None else 0, len(cols), wide):
            c = cols[j : j + wide]
            if (top[r] == top[r[0]]).all() and (top[c] == top[r[0]]).all():
                continue
            apart = np.zeros((len(r), len(c)), np.uint16)
            for at, lane in enumerate(lanes):
                apart += np.bitwise_count(lane[r][:, None] ^ lane[c][None, :])
                if at == 1 and not (apart <= radius).any():
                    break
            near = (apart <= radius) & (top[r][:, None] != top[c][None, :])
            left, right = np.nonzero(near)
            if not len(left):
                continue
            held.append((r[left], c[right], apart[near].astype(np.int64)))
            sure = held[-1][2] <= SURE
            top = _hang(top, held[-1][0][sure], held[-1][1][sure])
            if sum(len(h[0]) for h in held) > 1 << 18:
                held = [candidates(n, tuple(np.concatenate(x) for x in zip(*held, strict=True)))]
    return candidates(n, tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows, sorted by key, in tables that part no key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (kept and kept[-1].column(key)[-1].as_py() != k[-1]):
            kept.append(batch.slice(0, cut))
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def _wide(table: pa.Table) -> np.ndarray:
    return np.stack([np.asarray(table.column(c)).astype(np.int64) for c in _F], axis=1).view(np.uint64)


_FOUND = "a long, b long, pair long, side int, " + ", ".join(f"{c} long" for c in _F)


def _found(a: np.ndarray, b: np.ndarray, pair: np.ndarray | None = None, side: np.ndarray | None = None, fp: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch of candidates (a, b), or of rows b, in group a, that a pair of blocks holds."""
    none = lambda t: pa.nulls(len(a), t)
    f = [none(pa.int64()) if fp is None else pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(LANES)]
    cols = [pa.array(a), pa.array(b), none(pa.int64()) if pair is None else pa.array(pair), none(pa.int32()) if side is None else pa.array(side.astype(np.int32)), *f]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "pair", "side", *_F])


def compare_wide_cells(batches: Iterator[pa.RecordBatch], radius: int, window: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, rep, f0..f3) come sorted by cell, then f0..f3.  Compares every two rows
    of a cell.  A cell of over window rows is compared tile by tile, after its neighbours
    in order have told which surely hang together.  One of over block rows is cut into
    blocks, groups together, and its pairs of blocks are given out as rows, but for those
    that lie in one group.  Rows that hang together and may have pairs that are no candidates
    are given out as well, with side 2."""
    for table in _whole_groups(batches, "cell"):
        cell, who, fp = np.asarray(table.column("cell")), np.asarray(table.column("rep")), _wide(table)
        n = len(cell)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(first, n))
        rank, large = np.arange(n) - np.repeat(first, size), np.repeat(size > window, size)
        held, right = [_NONE], np.arange(n)
        for d in range(1, window):
            right = right[rank[right] >= d]
            if not len(right):
                break
            apart = np.bitwise_count(fp[right - d] ^ fp[right]).sum(1).astype(np.int64)
            near = apart <= np.where(large[right], SURE, radius)
            held.append((right[near] - d, right[near], apart[near]))
        held = [candidates(n, tuple(np.concatenate(x) for x in zip(*held, strict=True)))]
        at_large = large[held[0][0]]
        top = _hang(np.arange(n), held[0][0][at_large], held[0][1][at_large])
        for at, m in zip(first[size > window].tolist(), size[size > window].tolist(), strict=True):
            if m <= block:
                left, right, apart = _all_pairs(fp[at : at + m], top[at : at + m] - at, radius)
                held.append((left + at, right + at, apart))
                continue
            mine = top[at : at + m]
            order = at + np.lexsort((mine, -np.bincount(mine - at, minlength=m)[mine - at]))
            parts = [order[i : i + block] for i in range(0, m, block)]
            one = [int(top[p[0]]) if (top[p] == top[p[0]]).all() else -1 - i for i, p in enumerate(parts)]
            for i in range(len(parts)):
                for j in range(i, len(parts)):
                    if one[i] == one[j] >= 0:
                        continue
                    rows = parts[i] if i == j else np.concatenate([parts[i], parts[j]])
                    pair = X.mix(cell[at : at + 1].view(np.uint64) ^ X.mix(np.array([i << 32 | j], np.uint64))).view(np.int64)
                    yield _found(who[top[rows]], who[rows], np.repeat(pair, len(rows)), np.arange(len(rows)) >= len(parts[i]), fp[rows])
        left, right, _ = (np.concatenate(x) for x in zip(*held, strict=True))
        yield _found(who[left], who[right])
        # Of these, not all pairs are candidates.
        hung, over = _hang(np.arange(n), left, right), np.repeat(size > block, size)
        hung[over] = np.repeat(first, size)[over]
        rest = np.flatnonzero(np.bincount(hung, minlength=n)[hung] > np.where(large, 2, FEW))
        group = X.mix(cell[rest].view(np.uint64) ^ X.mix(who[hung[rest]].view(np.uint64))).view(np.int64)
        yield _found(group, who[rest], group, np.full(len(rest), 2))


def compare_blocks(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) between the two sides of every pair of blocks, or within its only
    one.  Rows come sorted by pair, then side."""
    for table in _whole_groups(batches, "pair"):
        pair, side, who, fp = np.asarray(table.column("pair")), np.asarray(table.column("side")), np.asarray(table.column("b")), _wide(table)
        _, top = np.unique(np.asarray(table.column("a")), return_inverse=True)
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
        for at, to in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            _, place, group = np.unique(top[at:to], return_index=True, return_inverse=True)
            split = int(np.searchsorted(side[at:to], 1))
            left, right, _ = _all_pairs(fp[at:to], place[group], radius, split if split < to - at else None)
            yield pa.RecordBatch.from_arrays([pa.array(who[at:to][left]), pa.array(who[at:to][right])], names=["a", "b"])


def wide_links(nodes: DataFrame, radius: int = RADIUS, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """nodes: (f0..f3, rep), fingerprints unique.  Candidates (a, b), a under b: of all pairs
    of reps within the radius that meet in a grid, those that candidates() keeps."""
    return _wide_links(nodes, radius, window, block)[0]


def _wide_links(nodes: DataFrame, radius: int, window: int, block: int) -> tuple[DataFrame, DataFrame, list[tuple[int, ...]]]:
    """wide_links(), (group, rep) of the rows among which it may keep not all pairs, and the
    grids."""
    grids = _sampled_grids(max(16, int(nodes.count()).bit_length() - 7))
    many = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = F.array(*[F.struct(F.lit(g[0]).alias("grid"), *[F.lit(m).alias(f"m{i}") for i, m in enumerate(g[1:])]) for g in grids])
    cell = F.xxhash64(*[F.col(c).bitwiseAND(F.col(f"k.m{i}")) for i, c in enumerate(_F)])
    dealt = nodes.select(*_F, "rep", F.explode(listed).alias("k")).select(*_F, "rep", F.xxhash64("k.grid", cell).alias("cell"))
    met = dealt.repartition(many, "cell").sortWithinPartitions("cell", *_F)
    found = X.written(met.mapInArrow(X.tidy(lambda it: compare_wide_cells(it, radius, window, block)), _FOUND), "wide-links")
    near, blocks = found.where("pair is null").select("a", "b"), found.where("side < 2")
    if not blocks.isEmpty():
        paired = blocks.repartition(many, "pair").sortWithinPartitions("pair", "side").mapInArrow(X.tidy(lambda it: compare_blocks(it, radius)), "a long, b long")
        near = near.unionByName(paired)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs, found.where("side = 2").select(F.col("pair").alias("group"), F.col("b").alias("rep")), grids


#: Rows and shingles at most of a block of texts that joined_blocks() compares with another,
#: blocks that a group is cut into if they have LEAST_ROWS each.
ROWS, SHINGLES, BLOCKS, LEAST_ROWS = 1024, 1 << 20, 8, 128


def shingle_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rep, words): the distinct shingles of the texts of the nodes (rep, doc_id, version)
    that are in pairs (a, b).  Each text is read once, by a join on its document."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(nodes.select("rep", "doc_id", "version"), "rep")
    texts = X.only(_keyed(docs).withColumn("doc", F.col("doc_id")), need.select(F.col("doc_id").alias("doc"))).join(need, ["doc_id", "version"]).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, texts = batch.column("rep"), X.as_bytes(batch.column("text"))
            for a, b in X.chunks(texts):
                sh, n = _sets(texts[a:b])
                own = [np.unique(x).view(np.int64) for x in np.split(sh, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([rep.slice(a, b - a), pa.array(own, pa.list_(pa.int64()))], names=["rep", "words"])

    return texts.mapInArrow(X.tidy(run), "rep long, words array<long>").dropDuplicates(["rep"])


def verified(known: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle_sets() have that Jaccard similarity."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (batch.column(c) for c in ("p", "q"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.asarray(p[i].values), np.asarray(q[i].values)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    left = pairs.join(known.select(F.col("rep").alias("a"), F.col("words").alias("p")), "a")
    return left.join(known.select(F.col("rep").alias("b"), F.col("words").alias("q")), "b").select("a", "b", "p", "q").mapInArrow(X.tidy(same), "a long, b long")


def _joining(fp: np.ndarray, comp: np.ndarray, split: int | None, words: np.ndarray, edge: np.ndarray, masks: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (left, right) of rows of different components comp that hang together what all
    pairs do that are within the radius, meet in a grid of masks and have that similarity;
    of all pairs of rows, or those of one row before split and one from it on.  Row i has the
    shingles words[edge[i]:edge[i + 1]]."""
    n = len(fp)
    _, top = np.unique(comp, return_inverse=True)
    _, word = np.unique(words, return_inverse=True)
    size, lanes, mine = np.diff(edge), np.ascontiguousarray(fp.T), np.zeros(int(word.max(initial=-1)) + 1, bool)
    left, right = [], []
    for i in range(n if split is None else split):
        start = i + 1 if split is None else split
        other = start + np.flatnonzero(top[start:] != top[i])
        # No two sets agree in more than the smaller one.
        other = other[np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i])]
        apart = sum(np.bitwise_count(lane[other] ^ lane[i]).astype(np.uint16) for lane in lanes)
        other = other[apart <= radius]
        if not len(other):
            continue
        of = word[edge[i] : edge[i + 1]]
        mine[of] = True
        # A few rows at a time: of rows that one link joins, the others need no look.
        a, step = 0, 256
        while a < len(other):
            some = other[a : a + step]
            a += step
            some = some[top[some] != top[i]]
            if not len(some):
                continue
            at = np.repeat(edge[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
            hits = np.concatenate([[0], np.cumsum(mine[word[at]])])
            end = np.cumsum(size[some])
            both = hits[end] - hits[end - size[some]]
            some = some[both >= similarity * (size[i] + size[some] - both)]
            some = some[((fp[some] ^ fp[i])[:, None, :] & masks).any(2).all(1) == 0]
            for j in some.tolist():
                if top[j] != top[i]:
                    left.append(i)
                    right.append(j)
                    top[top == top[j]] = top[i]
        mine[of] = False
    return np.array(left, np.int64), np.array(right, np.int64)


def joined_blocks(batches: Iterator[pa.RecordBatch], masks: np.ndarray, radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, rep, component, words, f0..f3) come sorted by cell, then side.  Gives
    links (a, b) within a cell's only side, or between its two: fewer than the cell has
    rows."""
    for table in _whole_groups(batches, "cell"):
        cell, side, who, comp = (np.asarray(table.column(c)) for c in ("cell", "side", "rep", "component"))
        fp, sets = _wide(table), pa.concat_arrays(table.column("words").chunks)
        words, edge = np.asarray(sets.values), np.asarray(sets.offsets).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        for at, to in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            split = None if side[at] == side[to - 1] else int(np.searchsorted(side[at:to], 1))
            left, right = _joining(fp[at:to], comp[at:to], split, words[edge[at] : edge[to]], edge[at : to + 1] - edge[at], masks, radius, similarity)
            a, b = who[at:to][left], who[at:to][right]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def joining(nodes: DataFrame, rest: DataFrame, found: DataFrame, pairs: DataFrame, known: DataFrame, grids: list[tuple[int, ...]], similarity: float, radius: int, most: int = ROWS) -> DataFrame:
    """Links (a, b) that hang together, with the components found of the verified pairs, what
    all pairs do that are in one group of rest (group, rep), within the radius, and have that
    similarity.

    Only links that join components come out, as the task that compares two texts has the
    shingle sets (known) of both.  So that a text is sent for one group, not for each of its
    cells, texts meet in what hangs together by pairs, verified or not.  Such a group is cut
    into blocks of `most` rows at most, large components apart from small ones, and every two
    blocks are compared, but for those of one component."""
    many = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    rows = X.written(rest.join(of("rep", "component"), "rep", "left").select("group", "rep", F.coalesce("component", "rep").alias("component")), "wide-rest")
    mixed = rows.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("group")
    # What hangs together by pairs, with components for nodes.
    over = pairs.join(of("a", "p"), "a", "left").join(of("b", "q"), "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")).where("a != b").distinct()
    whole = components(over).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    sizes = known.select("rep", F.size("words").alias("n"))
    rows = X.written(rows.join(mixed, "group").select("rep", "component").distinct().join(whole, "component").join(sizes, "rep"), "wide-rows")
    parts = rows.groupBy("whole", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    wide = parts.groupBy("whole").agg(F.least(F.lit(most), F.greatest(F.lit(min(LEAST_ROWS, most)), F.ceil(F.sum("c") / BLOCKS))).alias("rows"), F.count("*").alias("k")).where("k > 1").drop("k")
    parts = parts.join(wide, "whole").withColumn("weight", F.col("c") / F.col("rows") + F.col("n") / SHINGLES)
    bins = parts.where("weight <= 1").groupBy("whole").agg(F.ceil(F.sum("weight")).alias("bins"))
    parts = parts.join(bins, "whole", "left").select("whole", "component", F.when(F.col("weight") > 1, F.ceil("weight")).alias("cut"), "bins")
    block = F.when(F.col("cut") > 0, F.xxhash64("whole", "component", F.pmod(F.xxhash64("rep"), "cut"))).otherwise(F.xxhash64("whole", F.pmod(F.xxhash64("component"), "bins")))
    rows = X.written(rows.drop("n").join(parts, ["whole", "component"]).select("whole", "rep", "component", F.when(F.col("cut") > 0, F.col("component")).alias("large"), block.alias("block")), "wide-blocks")
    blocks = rows.select("whole", "large", "block").distinct()
    both = blocks.join(blocks.select("whole", F.col("large").alias("large_"), F.col("block").alias("block_")), "whole").where("block <= block_ and not (large <=> large_ and large is not null)").select("block", "block_", F.xxhash64("block", "block_").alias("cell"))
    sides = both.select("block", "cell", F.lit(0).alias("side")).unionByName(both.where("block < block_").select(F.col("block_").alias("block"), "cell", F.lit(1).alias("side")))
    dealt = rows.join(sides, "block").select("rep", "component", "cell", "side").join(nodes.select("rep", *_F), "rep").join(known, "rep")
    masks = np.array([g[1:] for g in grids], np.int64).view(np.uint64)
    sorted_ = dealt.select("cell", "side", "rep", "component", "words", *_F).repartition(many, "cell").sortWithinPartitions("cell", "side", "rep")
    return sorted_.mapInArrow(X.tidy(lambda it: joined_blocks(it, masks, radius, similarity)), "a long, b long").distinct()


#: Numbers in which shingle_counts() counts, rows of a cell of shared_cells() of which all
#: pairs are listed.
COUNTS, CELL = 1 << 18, 64


def _prefixes(sh: np.ndarray, n: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(text, shingle, place, size of the text's set) of the first shingles of each text, the
    rarest by counts first: as many as two sets of that similarity need to have one in common."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    once = np.concatenate([[True], (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])])[: len(sh)]
    sh, owner = sh[once], owner[once]
    order = np.lexsort((sh, counts[(sh >> np.uint64(46)).astype(np.int64)], owner))
    sh, size = sh[order], np.bincount(owner, minlength=len(n))
    place = np.arange(len(sh)) - np.repeat(np.cumsum(size) - size, size)
    on = place <= np.repeat(size - np.ceil(similarity * size - 1e-9).astype(np.int64), size)
    return owner[on], sh[on], place[on], size[owner[on]]


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles there are with each value of their hash's first bits.  They tell
    frequent ones, which many strangers share, from rare ones; any numbers would do."""
    pieces = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTS, np.int64)
        for batch in batches:
            texts = X.as_bytes(batch.column("text"))
            for a, b in X.chunks(texts):
                out += np.bincount((_sets(texts[a:b])[0] >> np.uint64(46)).astype(np.int64), minlength=COUNTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.tobytes() for x in np.split(out, pieces)], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                out[i] = out.get(i, 0) + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    summed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(X.tidy(count), schema).repartition(pieces, "piece").mapInArrow(X.tidy(add), schema)
    found = {r.piece: np.frombuffer(r.counts, np.int64) for r in summed.collect()}
    return np.concatenate([found[i] for i in range(pieces)]) if found else np.zeros(COUNTS, np.int64)


def shared_shingles(docs: DataFrame, similarity: float) -> DataFrame:
    """(token, version, n, place): the shingles of _prefixes() that several texts have."""
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = shingle_counts(docs)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, version = X.as_bytes(batch.column("text")), np.asarray(batch.column("version"))
            for a, b in X.chunks(texts):
                owner, sh, place, size = _prefixes(*_sets(texts[a:b]), counts, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(version[a:b][owner]), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], names=["token", "version", "n", "place"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "token"):
            token, version = np.asarray(table.column("token")), np.asarray(table.column("version"))
            new = np.concatenate([[True], token[1:] != token[:-1]])
            once = new | np.concatenate([[True], version[1:] != version[:-1]])
            group = np.cumsum(new) - 1
            yield from table.filter(pa.array(once & (np.bincount(group, once)[group] > 1))).to_batches()

    schema = "token long, version long, n int, place int"
    # A token's texts need not be together in order of anything but their version.
    texts = _keyed(docs).where("doc_id is not null and text is not null").select("version", "text")
    return texts.mapInArrow(X.tidy(listed), schema).repartition(many, "token").sortWithinPartitions("token", "version").mapInArrow(X.tidy(several), schema)


def shared_cells(batches: Iterator[pa.RecordBatch], similarity: float, cell: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, rep, component, n, place) come sorted by token, then rep.  Gives pairs
    (a, b, kind 0, n and place of each) of different components and sizes near enough.  Of a
    token with over `cell` rows these are (token, rep, kind 2) of every row, and pairs (a, b,
    kind 1) by which they hang together."""
    for table in _whole_groups(batches, "token"):
        token, rep, comp, n, place = (np.asarray(table.column(c)).astype(np.int64) for c in ("token", "rep", "component", "n", "place"))
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        rank, large = np.arange(len(token)) - np.repeat(first, size), np.repeat(size > cell, size)
        over = np.flatnonzero(large)
        step = over[rank[over] > 0]
        none = lambda k, i: (np.full(len(i), k), *[np.zeros(len(i), np.int64)] * 4)
        out = [(token[over], rep[over], *none(2, over)), (rep[step - 1], rep[step], *none(1, step))]
        right = np.flatnonzero(~large)
        for d in range(1, cell):
            right = right[rank[right] >= d]
            if not len(right):
                break
            left = right - d
            on = (comp[left] != comp[right]) & (np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right]) - 1e-6)
            x, y = left[on], right[on]
            out.append((rep[x], rep[y], np.zeros(len(x), np.int64), n[x], n[y], place[x], place[y]))
        a, b, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(x.astype(np.int32)) for x in rest)], names=["a", "b", "kind", "n", "m", "i", "j"])


def likely(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of pairs of kind 0 of shared_cells(), a row for each shingle that they share,
    that may have the similarity.  What they share beyond these shingles comes, in the order
    of all, after the last of them and after the end of one's first shingles."""
    past = lambda n: F.ceil(similarity * F.col(n) - 1e-9) - 1  # noqa: E731  shingles of a text that are not its first ones
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("m").alias("m"), F.max("i").alias("i"), F.max("j").alias("j"))
    most = F.col("both") + F.least(F.greatest(past("n"), past("m")), F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1)
    return pairs.where(most >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6).select("a", "b")


def completed(docs: DataFrame, classes: DataFrame, similarity: float, most: int = ROWS, cell: int = CELL) -> DataFrame:
    """classes (doc_id, version, keep), a table, with those joined that any two texts of that
    similarity are in.

    Two sets of that similarity have one of their first shingles in common, in any order of
    shingles that all texts share (see _prefixes()), so every such pair meets in a shingle.
    Pairs that are in one class already are not looked at."""
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = X.written(shared_shingles(docs, similarity), "shared-shingles")
    texts = classes.where("doc_id is not null").groupBy("version").agg(F.min(F.struct("doc_id", "keep")).alias("own"))
    nodes = X.written(texts.select(F.monotonically_increasing_id().alias("rep"), "version", "own.doc_id", "own.keep"), "shared-nodes")
    label = nodes.groupBy("keep").agg(F.min("rep").alias("component"))
    found = X.written(nodes.join(label, "keep").select(F.col("rep").alias("node"), "component"), "shared-classes")
    met = shared.join(nodes.select("version", "rep"), "version").join(found, F.col("rep") == F.col("node")).select("token", "rep", "component", "n", "place")
    mixed = X.written(met, "shared-met")
    X.forget(shared)
    several = mixed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    dealt = mixed.join(several, "token").repartition(many, "token").sortWithinPartitions("token", "rep")
    told = X.written(dealt.mapInArrow(X.tidy(lambda it: shared_cells(it, similarity, cell)), "a long, b long, kind int, n int, m int, i int, j int"), "shared-pairs")
    X.forget(mixed)
    pairs = X.written(likely(told.where("kind = 0"), similarity), "shared-likely")
    # A pair that shares a shingle of a large cell is compared there, whatever else it shares.
    chain = told.where("kind = 1").select("a", "b").distinct()
    if pairs.isEmpty() and chain.isEmpty():
        return classes
    known = X.written(shingle_sets(docs, nodes, pairs.unionByName(chain)), "shared-sets")
    same = X.written(verified(known, pairs, similarity), "shared-same")
    of = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    links = lambda near: near.join(of("a", "p"), "a").join(of("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    rest = told.where("kind = 2").select(F.col("a").alias("group"), F.col("b").alias("rep"))
    if not rest.isEmpty():
        moved = components(links(same)).select(F.col("node").alias("component"), F.col("component").alias("now"))
        now = X.written(found.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "shared-now")
        # Every two meet in a grid without bits, and none differ in more bits than there are.
        blank = nodes.select("rep", *[F.lit(0).cast("long").alias(c) for c in _F])
        more = joining(blank, rest, now, chain, known, [(0,) * (LANES + 1)], similarity, 64 * LANES, most)
        same = X.written(same.unionByName(more), "shared-links")
    one = components(links(same)).join(label.select(F.col("component").alias("node"), "keep"), "node")
    least = one.groupBy("component").agg(F.min("keep").alias("now"))
    moved = X.written(one.join(least, "component").select("keep", "now").where("keep != now"), "shared-moved")
    return classes.join(moved, "keep", "left").select("doc_id", "version", F.coalesce("now", "keep").alias("keep"))


def _classes(docs: DataFrame, similarity: float, radius: int | None, window: int, block: int) -> DataFrame:
    """(doc_id, version, keep) of every row: keep is the least (doc_id, version) of its class,
    null in a class of null ids alone."""
    if radius is not None:
        return _grid_classes(docs, similarity, radius, window, block)
    classes = X.written(_grid_classes(docs, similarity, RADIUS, window, block), "grid-classes")
    docs.sparkSession.sparkContext._jvm.System.gc()  # Spark deletes what was shuffled
    return completed(docs, classes, similarity, min(ROWS, block))


def _grid_classes(docs: DataFrame, similarity: float, radius: int, window: int, block: int) -> DataFrame:
    """_classes() of links of texts within the radius that meet in a grid."""
    fps = X.written(wide_fingerprints(docs), "wide-fingerprints")
    grouped = fps.where("doc_id is not null").groupBy(*_F).agg(F.min(F.struct("doc_id", "version")).alias("own"))
    nodes = X.written(grouped.select(F.monotonically_increasing_id().alias("rep"), *_F, "own.doc_id", "own.version"), "wide-nodes")
    near, rest, grids = _wide_links(nodes, radius, window, block)
    pairs = X.written(near, "wide-pairs")
    known = X.written(shingle_sets(docs, nodes, pairs), "shingles")
    same = X.written(verified(known, pairs, similarity), "wide-same")
    found = X.written(components(same), "wide-components")
    more = X.written(joining(nodes, rest, found, pairs, known, grids, similarity, radius, min(ROWS, block)), "wide-more")
    if not more.isEmpty():
        found = X.written(components(same.unionByName(more)), "wide-components")
    least = found.join(nodes, found.node == nodes.rep).groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("keep"))
    of_node = nodes.join(found.join(least, "component"), nodes.rep == F.col("node"), "left").select(*_F, F.coalesce("keep", F.struct("doc_id", "version")).alias("keep"))
    return fps.join(of_node, _F, "left").select("doc_id", "version", "keep")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, radius: int | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of every row: near duplicates, by the Jaccard similarity of
    five-word shingles, hang together; component_id is the least doc_id.

    At a similarity of 0.8 no choice of groups of bits must agree, so grids are drawn: each
    has the bit counts of segments of one bit, 16 at least and one more with each doubling
    from 2**23 distinct fingerprints on, so that a cell has some 128 strangers at most.
    There are as many grids as fingerprints at the usual distance need to meet in one with
    a chance of MEETING, at any size; nearer ones meet more surely.  All rows of a cell are
    compared, those of a cell of over `block` rows by pairs of blocks, so this takes time
    with the square of the largest cells, but for groups that surely hang together.  Pairs
    within the radius are verified on their shingle sets: first a few of each group that
    hangs together, then all others whose two are not yet in one class; of these only the
    links that join classes come out, fewer than there are rows.

    These links may lack one pair in twenty at a similarity of 0.8: those that differ in more
    than RADIUS bits or meet in no grid.  So completed() then joins the classes of all other
    pairs, by their shingles alone, and no link is lost.  If a radius is given, only links
    within it that meet in a grid count.

    Equal fingerprints always share a class; so do all texts without words, null or empty.
    Fewer than five words make one shingle.  Rows that share a doc_id are told apart by
    their texts.  A row with a null id takes the class of its fingerprint, a null one where
    all ids are null.  Ties go to the least doc_id.  Other columns are ignored; an empty
    table gives no rows.
    """
    return _classes(docs, similarity, radius, window, block).select("doc_id", F.col("keep.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near_duplicates(), all columns as they were: the
    least doc_id's (of texts that share it, the one with the least hash; of rows that repeat
    id and text, the least by the other columns).  A null or empty text is a text without
    words, so one such row stays.  Rows with a null doc_id are of no class here: they stay.
    An empty table gives no rows; columns of any name and type pass through."""
    classes = X.written(_classes(docs, similarity, None, WINDOW, BLOCK), "near-classes")
    mine = classes.where("doc_id is not null")
    gone = mine.where("doc_id != keep.doc_id or version != keep.version").select(F.col("doc_id").alias("_gone"), F.col("version").alias("_version")).distinct()
    at = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    kept = docs.join(gone, (at[0] == F.col("_gone")) & (at[1] == F.col("_version")), "left_anti")
    repeated = mine.where("doc_id = keep.doc_id and version = keep.version").groupBy("doc_id", "version").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice"), F.col("version").alias("_version"))
    if repeated.isEmpty():
        return kept
    twice = X.written(repeated, "near-repeats")
    on = (at[0] == F.col("_twice")) & (at[1] == F.col("_version"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = kept.join(twice, on).groupBy("_twice", "_version").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.join(twice, on, "left_anti").unionByName(least)
