"""Document likelihoods over all segmentations into subword pieces.

The pieces are those of an existing vocabulary; none is learned.  A piece's score is its
log probability in the training documents, counted over their segmentation by that
vocabulary's tokenizer and smoothed by one.  A word's probability is the sum over all ways
to cut it into pieces, found by a forward recursion in log space; any character can also
be spelled in bytes, so every word has a probability.  No piece crosses a word's border,
so a document's probability is the product of its words' and the end's.

Each distinct word is scored once.  Documents are dealt into buckets of some megabytes;
a bucket sends its distinct words, a shuffle by word counts and scores them, and the
scores go back to the buckets that asked.  What moves is distinct words of buckets, not
tokens, and no table of words is ever broadcast or collected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .langid import held_out

#: Bytes of text in a bucket; the larger figure holds from 256 GB on.
BUCKET_BYTES = (8 << 20, 64 << 20)
_loaded: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(path: str):
    if path not in _loaded:
        from sentencepiece import SentencePieceProcessor

        _loaded[path] = SentencePieceProcessor(model_file=path)
    return _loaded[path]


class Lattice:
    """Log probabilities of words, from how often each piece was counted."""

    def __init__(self, path: str, counts: dict[int, int], ends: int):
        sp = _processor(path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
        total = log(sum(counts.get(i, 0) for i in ids) + ends + len(ids) + 1)
        self.end = log(ends + 1) - total
        self.pieces: dict[str, float] = {}
        self.bytes = [float("-inf")] * 256
        for i in ids:
            p = log(counts.get(i, 0) + 1) - total
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = p
            else:
                self.pieces[sp.id_to_piece(i)] = p
        self.longest = max(map(len, self.pieces), default=1)
        self.characters: dict[str, float] = {}

    def _character(self, c: str) -> float:
        """A character as a piece of its own or in bytes."""
        p = self.characters.get(c)
        if p is None:
            p = sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))
            if c in self.pieces:
                q = self.pieces[c]
                p = max(p, q) + log(1 + exp(min(p, q) - max(p, q)))
            if len(self.characters) < 1 << 16:
                self.characters[c] = p
        return p

    def word(self, word: str) -> float:
        """The log of the sum, over all segmentations, of the product of their pieces."""
        s, get, longest = "▁" + word, self.pieces.get, self.longest
        a = [0.0]
        for i in range(1, len(s) + 1):
            terms = [a[i - 1] + self._character(s[i - 1])]
            for j in range(max(0, i - longest), i - 1):
                p = get(s[j:i])
                if p is not None:
                    terms.append(a[j] + p)
            if len(terms) == 1:
                a.append(terms[0])
            else:
                top = max(terms)
                a.append(top + log(sum([exp(t - top) for t in terms])))
        return a[-1]


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _asked(dealt: DataFrame) -> DataFrame:
    """(bucket, word, n): the distinct words of each bucket, and how often its training
    documents have them.  Rows of a bucket come from one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught: dict[int, Counter] = {}
        other: dict[int, set] = {}
        for batch in batches:
            for text, held, bucket in zip(X.as_bytes(batch.column("text")), batch.column("held_out").to_pylist(), batch.column("bucket").to_pylist(), strict=True):
                if held:
                    other.setdefault(bucket, set()).update(_words(text))
                else:
                    taught.setdefault(bucket, Counter()).update(_words(text))
        for bucket in taught.keys() | other.keys():
            counts = taught.pop(bucket, Counter())
            words = [*counts, *other.pop(bucket, set()).difference(counts)]
            n = np.zeros(len(words), np.int64)
            n[: len(counts)] = list(counts.values())
            for a in range(0, len(words), 1 << 16):
                part = words[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket, np.int32)), pa.array([w.decode() for w in part], pa.string()), pa.array(n[a : a + len(part)])], names=["bucket", "word", "n"])

    return dealt.mapInArrow(X.tidy(run), "bucket int, word string, n long")


def piece_counts(vocabulary: DataFrame, path: str) -> dict[int, int]:
    """How often each piece stands in the tokenizer's segmentation of the training words
    (word, c); no more entries than the vocabulary has pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            got = sp.encode(batch.column("word").to_pylist(), num_threads=1)
            flat = np.fromiter((i for g in got for i in g), np.int64)
            np.add.at(total, flat, np.repeat(np.asarray(batch.column("c")), [len(g) for g in got]))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

    counted = vocabulary.where("c > 0").select("word", "c").mapInArrow(X.tidy(run), "piece int, n long")
    return {r.piece: r.n for r in counted.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def score(docs: DataFrame, vocabulary: str | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the lower-cased words and one end.  Training documents are those whose
    crc32 of doc_id as text does not leave 2 modulo 7; a null doc_id counts as one of
    them.  base_score is the smoothed unigram log10 probability by whole words, score the
    lattice's.  A null text is empty: the end alone.  Repeated rows are counted and scored
    each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    X.bounded_batches(spark)
    path = vocabulary or default_vocabulary()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), 7).alias("held_out"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n"), F.count_if(~F.col("held_out")).alias("ends")).first()
    each = bucket_bytes or min(max(size.n // 4096, BUCKET_BYTES[0]), BUCKET_BYTES[1])
    many = int(size.n // each) + 1
    dealt = slim.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)).cast("int")).repartition(many, "bucket")
    words = X.written(_asked(dealt).groupBy("word").agg(F.sum("n").alias("c"), F.collect_list("bucket").alias("buckets")), "words")
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, distinct, ends = seen.n + size.ends, seen.v + (size.ends > 0), size.ends
    pieces = piece_counts(words, path)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, pieces, ends)
        for batch in batches:
            p = np.fromiter(map(lattice.word, batch.column("word").to_pylist()), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=["word", "c", "buckets", "p"])

    answers = words.mapInArrow(X.tidy(scored), "word string, c long, buckets array<int>, p double").select(F.explode("buckets").alias("bucket"), "word", "c", "p")
    end_base, end_model = log10((ends + 1) / (tokens + distinct + 1)), Lattice(path, pieces, ends).end / log(10)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        number = dict(zip(X.as_bytes(right.column("word")), range(right.num_rows), strict=True))
        c = np.asarray(right.column("c"), np.float64)
        base, model, known = np.log10((c + 1) / (tokens + distinct + 1)), np.asarray(right.column("p")) / log(10), c > 0
        rows = []
        for text in X.as_bytes(left.column("text")):
            ws = _words(text)
            at = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
            rows.append((len(ws) + 1, int(known[at].sum()) + (ends > 0), float(base[at].sum()) + end_base, float(model[at].sum()) + end_model))
        n, k, b, m = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table([left.column("doc_id"), left.column("held_out"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([tokens] * len(n), pa.int64()), pa.array(b, pa.float64()), pa.array(m, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
