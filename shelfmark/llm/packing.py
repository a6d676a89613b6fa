"""Best-fit packing of tokenized documents by minimum bin slack.

Documents are tokenized and cut into pieces of at most `capacity` tokens.  Packing sees
only how many pieces there are of each length, a table of at most `capacity` rows
whatever the size of the corpus.  A bin starts with the longest length left; a subset-sum
over the other lengths, a bitset of reachable fills, finds the fullest combination, which
is taken as often as its lengths last.  Each step uses up a length, so there are no more
patterns than lengths.  Pieces are numbered within their length on Spark, and the number
tells which pattern, bin and place a piece gets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import textops as X

CAPACITY = 4096
END = 1
#: Words whose token ids a worker keeps, about 40 bytes each; beyond it the store is
#: emptied and refilled.  Longest word that is kept, and how many words the small tier
#: takes in before it is merged into the large one.
STORE, LONGEST, LATEST = 1_500_000, 64, 60_000
#: Parts in which the pieces of one length are numbered, at least, and pieces for each part
#: beyond.
PARTS, PART_ROWS = 64, 1 << 20
_stores: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _one_pretoken(w: str) -> bool:
    """Surely a single run of letters for the tokenizer, before and after lower-casing."""
    return w.isalpha() and (w.isascii() or max(w) < "ɐ" and "İ" not in w)


class WordTokens:
    """Token ids of words.  The tokenizer splits at white space, so a text's ids are those
    of its words.  Ids of words seen before are kept in flat arrays, found by a 64-bit hash
    of the word; words of over LONGEST bytes are not kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        #: (hash, place, number of ids), sorted by hash: those of long ago and the latest.
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.tiers = [empty, empty]
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word.  Simple words are encoded by the hundred, and told apart by the
        tokens that end a run of letters or of signs."""
        out: list[np.ndarray | None] = [None] * len(words)
        texts = [w.decode() for w in words]
        groups: dict[int, list[int]] = {1: [], 2: [], 0: []}
        for i, s in enumerate(texts):
            groups[1 if _one_pretoken(s) else 2 if s[-1] in ".,;:" and _one_pretoken(s[:-1]) else 0].append(i)
        for runs in (1, 2):
            parts = [groups[runs][i : i + 256] for i in range(0, len(groups[runs]), 256)]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                stop = np.flatnonzero(self.ends[ids])[runs - 1 :: runs] + 1
                if len(stop) != len(part):
                    groups[0].extend(part)
                    continue
                at = 0
                for i, b in zip(part, stop.tolist(), strict=True):
                    out[i] = ids[at:b]
                    at = b
        for i, e in zip(groups[0], self.tokenizer.encode_batch_fast([texts[i] for i in groups[0]], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4")
        return out

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of ids) of hashes; the number is -1 where a word is not kept."""
        place, n = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        for keys, places, sizes in self.tiers:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                place[hit], n[hit] = places[at[hit]], sizes[at[hit]]
        return place, n

    def _keep(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(n.sum())
        if self.used + total > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used + total), "<u4")
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + total] = np.concatenate([*ids, np.zeros(0, "<u4")])
        place = self.used + np.cumsum(n) - n
        self.used += total
        order = np.argsort(h)
        tier = (h[order], place[order].astype(np.int64), n[order])
        merge = lambda old, new: tuple(np.insert(a, np.searchsorted(old[0], new[0]), b) for a, b in zip(old, new, strict=True))
        self.tiers[1] = merge(self.tiers[1], tier)
        if len(self.tiers[1][0]) > LATEST:
            self.tiers = [merge(self.tiers[0], self.tiers[1]), tuple(x[:0] for x in tier)]

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids, little-endian in 32 bits."""
        out: list[bytes] = []
        for a, b in X.chunks(texts):
            start, end, h, counts = X.hashed_words(texts[a:b], X.PLAIN)
            joined = b" ".join(t or b"" for t in texts[a:b])
            if len(self.tiers[0][0]) > STORE:
                self.clear()
            some, first, back = np.unique(h, return_index=True, return_inverse=True)
            long = end[first] - start[first] > LONGEST
            place, n = self._find(some)
            new = np.flatnonzero((n < 0) & ~long)
            if len(new):
                self._keep(some[new], self._encode([joined[start[i] : end[i]] for i in first[new].tolist()]))
                place[new], n[new] = self._find(some[new])
            n[long] = 0
            lengths = n[back]
            upto = np.cumsum(lengths)
            ids = self.flat[np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - lengths, lengths) + np.repeat(place[back], lengths)]
            if long.any():
                # Rare words of over LONGEST bytes are put in where they stand.
                at = np.flatnonzero(end - start > LONGEST)
                more = self._encode([joined[start[i] : end[i]] for i in at.tolist()])
                ids = np.insert(ids, np.repeat(upto[at], [len(m) for m in more]), np.concatenate(more))
                lengths = lengths.copy()
                lengths[at] = [len(m) for m in more]
                upto = np.cumsum(lengths)
            stop = np.concatenate([[0], upto])[np.cumsum(counts)]
            raw, begin = ids.astype("<u4").tobytes(), 0
            for e in (4 * stop).tolist():
                out.append(raw[begin:e])
                begin = e
        return out


def _worker_tokens(path: str) -> WordTokens:
    """One store for each worker, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _stores:
        _stores[path] = (WordTokens(path),)
    return _stores[path][0]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids with the
    end id; only documents of over `capacity` ids are cut.  A null text is empty."""
    X.bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(path)
        for batch in batches:
            got = [t + END.to_bytes(4, "little") for t in tokens.texts(X.as_bytes(batch.column("text")))]
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, t in enumerate(got):
                for p, a in enumerate(range(0, len(t), 4 * capacity)):
                    part = t[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        raw.append(np.frombuffer(part, "<i4"))
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if ids:
                cols.append(pa.array(raw, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(X.tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def fullest(lengths: list[tuple[int, int]], room: int) -> list[int]:
    """The lengths, each at most as often as it is given, whose sum is the largest up to
    room.  lengths: (length, count), longest first."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for size, count in lengths:
        if reach >> room & 1:
            break
        for _ in range(min(count, room // size)):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            steps.append((size, reach))
            reach = more
    fill, taken = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> fill & 1:
            taken.append(size)
            fill -= size
    return taken


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, how many in a bin), ...]) by minimum bin slack; uses up counts."""
    left, out = dict(sorted(counts.items(), reverse=True)), []
    while left:
        first = next(iter(left))
        rest = [(s, n - (s == first)) for s, n in left.items() if s <= capacity - first and n > (s == first)]
        need: dict[int, int] = {first: 1}
        for s in fullest(rest, capacity - first):
            need[s] = need.get(s, 0) + 1
        bins = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= bins * n
            if not left[s]:
                del left[s]
        out.append((bins, sorted(need.items(), reverse=True)))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every
    piece of every row of docs; ids: with the token ids themselves.

    Sequences are numbered from 0 and filled without gaps from offset 0.  A null or empty
    text is one piece, the end id.  Repeated rows are packed each; equal lengths go by
    doc_id, piece and checksum.  Other columns are ignored; an empty table gives no rows.
    """
    rows = X.written(pieces(docs, tokenizer, capacity, ids), "pieces")
    parts = max(PARTS, rows.count() // PART_ROWS)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    counts = rows.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    # At most capacity x parts rows: broadcast up to 13 MB, else joined as the window dealt it.
    first = counts.withColumn("first", F.sum("n").over(W.Window.partitionBy("length").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1))).select("length", "part", F.coalesce("first", F.lit(0)).alias("first"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found, key, low, base, each, offset, bins_before = patterns(total, capacity), [], [], [], [], [], 0
    used: dict[int, int] = {}
    for bins, lengths in found:
        at = 0
        for size, n in lengths:
            key.append(size)
            low.append(used.get(size, 0))
            base.append(bins_before)
            each.append(n)
            offset.append(at)
            used[size] = used.get(size, 0) + bins * n
            at += size * n
        bins_before += bins
    order = np.lexsort((low, key)) if key else np.zeros(0, np.int64)
    table = [np.array(x, np.int64)[order] for x in (key, low, base, each, offset)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, base, each, offset = table
        starts = key << 44 | low
        for batch in batches:
            size, n = np.asarray(batch.column("length")), np.asarray(batch.column("n"))
            at = np.searchsorted(starts, size << 44 | n, side="right") - 1
            nth = n - low[at]
            cols = {c: batch.column(c) for c in batch.schema.names if c != "n"}
            cols |= {"sequence_id": pa.array(base[at] + nth // each[at]), "offset": pa.array(offset[at] + nth % each[at] * size)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    own = W.Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("part", part).withColumn("n", F.row_number().over(own)).join(F.broadcast(first) if parts == PARTS else first, ["length", "part"])
    names = [c for c in rows.columns if c != "ids"]
    slim = numbered.select(*names, *["ids"] * ids, (F.col("n") - 1 + F.col("first")).alias("n"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids + ", sequence_id long, offset long"
    return slim.mapInArrow(X.tidy(place), kind)
