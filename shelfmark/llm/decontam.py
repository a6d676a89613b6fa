"""Benchmark decontamination with an FM-index for each shard of training text.

A window of a benchmark item is ten consecutive words; an item of fewer words is one
window.  Words are numbered by the benchmark's vocabulary.  A word that no item has ends
every possible occurrence, so a shard indexes the runs of numbered words that are as long
as the shortest window, and loses nothing.  Over a shard's runs there are a suffix array,
its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions.  All
windows are searched backward at once, occurrences are located by walking to the next
sampled position, and their spans are merged within each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X

WINDOW = 10
#: Words that one shard's index holds before it is searched (a whole document at least).
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text that tasks get at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 16 << 20
#: Every such position of the text has its suffix position stored.
SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many queries at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(symbols)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `upto` elements."""
        low, high = np.zeros_like(upto), upto
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, one = self.ones[i], (symbol >> level) & 1 == 1
            low = np.where(one, self.zeros[i] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[i] + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        out = np.zeros_like(at)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[i]
            one = ones[at + 1] - ones[at] == 1
            out |= one.astype(out.dtype) << level
            at = np.where(one, self.zeros[i] + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length that is sorted."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:] if step < n else second[: n - step]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search over a sequence of symbols from 1 on; 0 separates runs."""

    def __init__(self, runs: list[np.ndarray], sigma: int):
        self.text = np.concatenate([np.append(r, 0) for r in runs]).astype(np.int64)
        order = suffix_array(self.text)
        bwt = self.text[order - 1]
        self.matrix = WaveletMatrix(bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=sigma))])
        # A run's first word is sampled too, so no walk crosses a separator.
        self.sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted suffixes [low, high) that start with each pattern, given as
        rows aligned to the right and padded with -1 on the left."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.text), np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((low < high) & (patterns[:, j] >= 0))
            if len(live):
                c = patterns[live, j]
                low[live] = self.before[c] + self.matrix.rank(c, low[live])
                high[live] = self.before[c] + self.matrix.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the sorted suffixes."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            row = at[open_]
            done = self.sampled[row]
            out[open_[done]] = self.samples[self.sample_rank[row[done]]] + steps[open_[done]]
            open_, row = open_[~done], row[~done]
            c = self.matrix.access(row)
            at[open_] = self.before[c] + self.matrix.rank(c, row)
            steps[open_] += 1
        return out


class Windows:
    """The windows of a block of benchmark items as rows of word numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        at = {i: k for k, i in enumerate(self.ids)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in text.translate(X.ALNUM_LOWER).split()]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + size]), set()).update([at[item]] if item is not None else [])
        self.length = np.fromiter(map(len, owners), np.int64, len(owners))
        self.rows = np.full((len(owners), size), -1, np.int64)
        for k, w in enumerate(owners):
            self.rows[k, size - len(w) :] = w
        self.owners = [sorted(o) for o in owners.values()]
        self.shortest = int(self.length.min()) if owners else 1 << 62


def search_texts(texts: list[bytes | None], windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[list[int]]]:
    """(number of words, merged hit spans in words, indexes of items found) of each text.
    Texts are indexed in shards."""
    n_words = [0] * len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[int]] = [set() for _ in texts]
    runs: list[np.ndarray] = []
    homes: list[tuple[int, int]] = []
    get = windows.number.get

    def flush() -> None:
        if not runs:
            return
        index = FMIndex(runs, len(windows.number) + 1)
        low, high = index.search(windows.rows)
        which = np.repeat(np.arange(len(low)), high - low)
        if len(which):
            rows = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]
            pos = index.locate(rows)
            start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in runs])])
            run = np.searchsorted(start, pos, side="right") - 1
            hits: dict[int, list[tuple[int, int]]] = {}
            for w, p, r in zip(which.tolist(), pos.tolist(), run.tolist(), strict=True):
                doc, first = homes[r]
                a = first + p - int(start[r])
                hits.setdefault(doc, []).append((a, a + int(windows.length[w])))
                found[doc].update(windows.owners[w])
            for doc, got in hits.items():
                spans[doc].extend(got)
        runs.clear()
        homes.clear()

    held = 0
    for d, text in enumerate(texts):
        words = (text or b"").translate(X.ALNUM_LOWER).split()
        n_words[d] = len(words)
        if len(words) < windows.shortest:
            continue
        number = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.concatenate([[False], number > 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        first, last = edge[::2], edge[1::2]
        for a, b in zip(first[last - first >= windows.shortest].tolist(), last[last - first >= windows.shortest].tolist(), strict=True):
            runs.append(number[a:b])
            homes.append((d, a))
            held += b - a
        if held >= SHARD_WORDS:
            flush()
            held = 0
    flush()
    merged = []
    for got in spans:
        out: list[tuple[int, int]] = []
        for a, b in sorted(got):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        merged.append(out)
    return n_words, merged, [sorted(f) for f in found]


def _items(bench: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Distinct (item_id, text, block) and the number of blocks of about block_bytes.  Null
    texts have no words and are left out."""
    items = bench.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0)).alias("n")).first().n
    many = max(1, -(-size // block_bytes))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(many))), many


def with_hits(docs: DataFrame, bench: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column: n_words, spans (merged ranges of hit words), items (ids
    of the items that have windows in the text)."""
    X.bounded_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
    arrow = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
    out = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def searching(items: list[tuple[str | None, bytes]], has: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(items)
            for batch in batches:
                n, spans, found = search_texts(X.as_bytes(batch.column("text")), windows)
                old = batch.column(name).to_pylist() if has else [None] * len(n)
                rows = [{"n_words": a, "spans": [*(o["spans"] if o else []), *map(list, s)], "items": [*(o["items"] if o else []), *(windows.ids[i] for i in f)]} for a, s, f, o in zip(n, spans, found, old, strict=True)]
                keep = [c for c in batch.schema.names if c != name]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, arrow)], names=[*keep, name])

        return run

    # One block at a time is read by the driver and searched for by the tasks: what either
    # holds has a bound whatever the size of the benchmark.
    items, many = _items(bench, block_bytes)
    for i in range(many):
        block = [(r.item_id, r.text.encode()) for r in items.where(F.col("block") == i).collect()]
        docs = docs.mapInArrow(X.tidy(searching(block, i > 0)), out)
        if i + 1 < many:
            docs = X.written(docs, "hits")
    return docs


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def contamination(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row.

    spans are merged ranges [start, end) of hit words; n_hit is their length.  A null
    text has no words.  Items without words are no windows; rows of one item_id count as
    one item; an item with a null id hits words but is not counted or listed.  Repeated
    rows come back as often as they came; other columns are ignored; an empty table of
    documents gives no rows and an empty benchmark hits nothing.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = with_hits(slim, bench, "h", block_bytes).select("doc_id", "h.*")
    sorted_spans = F.sort_array("spans")
    merge = F.aggregate(sorted_spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e")), lambda s, x: F.struct((s["n"] + F.greatest(x[1] - F.greatest(x[0], s["e"]), F.lit(0))).alias("n"), F.greatest(x[1], s["e"]).alias("e")))
    items = F.array_sort(F.array_distinct("items"))
    return hits.select("doc_id", "n_words", merge["n"].alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), sorted_spans.alias("spans"))


def cut_spans(text: bytes, spans: list[list[int]], table: bytes = X.ALNUM_LOWER) -> bytes:
    """The text without the words of these spans, nor what stands between them."""
    marks = np.frombuffer(text.translate(table), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : int(start[a])])
        at = int(end[b - 1])
    return b"".join([*out, text[at:]])


def remove_benchmark(docs: DataFrame, bench: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the hit spans cut out of their texts, all else as it was; n_chars, where
    there is such a column, follows the text.

    A document that is cut down to no word goes; one that had none before, null or empty,
    stays, as do rows with a null id.  Repeated rows are cut alike.  An empty benchmark
    leaves all as it was, an empty table gives no rows, and columns of other names pass
    through."""
    own = "_shelfmark_hits"
    while own in docs.columns:
        own += "_"
    hit = with_hits(docs, bench, own, block_bytes)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(own).field("spans").to_pylist()
            texts = X.as_bytes(batch.column("text"))
            new = [cut_spans(t, merge_spans(s)) if s else t for t, s in zip(texts, spans, strict=True)]
            keep = np.array([not s or bool(t.translate(X.ALNUM_LOWER).strip()) for t, s in zip(new, spans, strict=True)], bool)
            cols = [pa.array([None if t is None else t.decode() for t in new], batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([len(t.decode()) if s else o for t, s, o in zip(new, spans, cols[i].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return hit.mapInArrow(X.tidy(run), docs.schema)
