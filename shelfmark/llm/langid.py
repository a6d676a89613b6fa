"""Language identification by rank-order profiles of character n-grams.

Letters are lower-cased and every run of other characters becomes one space.  A profile
lists a language's most frequent n-grams of one to three characters by rank.  A document
is compared with each profile by out-of-place distance: the sum, over the document's own
most frequent n-grams, of how far their ranks differ, an n-gram that a profile lacks
counting as the profile's full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import textops as X

#: N-grams in a profile, of a language and of a document.
PROFILE = 400
#: Languages whose profiles tasks get at once; more are compared in blocks.
BLOCK_LANGUAGES = 500
#: Distinct (language, n-gram) pairs that a task holds before it passes them on.
HELD = 1 << 20
_letters: list[np.ndarray] = []


def held_out(doc_id: Column, parts: int = 4) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 2, F.lit(False))


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """The text's n-grams of one, two and three characters, as numbers; an n-gram that is
    a space alone is left out.  No letter: none."""
    if not text:
        return np.zeros(0, np.int64)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    a = np.where(_is_letter()[a], a, 32)
    if not (a != 32).any():
        return np.zeros(0, np.int64)
    a = np.concatenate([[32], a, [32]])
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    two = a[:-1] << 21 | a[1:]
    return np.concatenate([a[a != 32], two, two[:-1] << 21 | a[2:]])


def _counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(g, return_counts=True)


def train(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the profile of each language, rank 0 being the most frequent;
    ties go by the n-gram's number.  docs: text, lang; rows with a null lang teach
    nothing."""
    X.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                parts.setdefault(lang, []).append(grams(text))
            for lang, p in parts.items():
                g, n = _counted(np.concatenate(p))
                if lang in held:
                    g, back = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([held[lang][1], n]), len(g)).astype(np.int64)
                held[lang] = g, n
            if sum(len(g) for g, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    slim = docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = slim.mapInArrow(X.tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < profile).select("lang", "gram", "rank")


def _nearest(text: str | None, langs: list[str], known: np.ndarray, ranks: np.ndarray, profile: int) -> tuple[str, float]:
    g = grams(text)
    if not len(g) or not langs:
        return "und", 0.0
    g, n = _counted(g)
    top = np.lexsort((g, -n))[:profile]
    own = g[top]
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    apart = np.abs(ranks[:, at] - np.arange(len(own)))
    apart = np.where((known[at] == own) & (ranks[:, at] < profile), np.minimum(apart, profile), profile)
    total = apart.sum(1)
    best = int(total.argmin())
    return langs[best], float(1 - total[best] / (profile * len(own)))


def predict(docs: DataFrame, profiles: DataFrame, profile: int = PROFILE, block: int = BLOCK_LANGUAGES) -> DataFrame:
    """docs (doc_id, text, and whatever else) with lang_pred and score.

    score is 1 less the distance as a part of the largest possible one.  Equal distances
    go to the language that sorts first.  A null text, a text without a letter, and any
    text when nothing was learned give `und` with score 0.  More than `block` languages
    are compared block by block.
    """
    X.bounded_batches(docs.sparkSession)
    langs = [r.lang for r in profiles.select("lang").distinct().orderBy("lang").collect()]
    schema = [*docs.schema.fields]
    out = docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    for first in range(0, len(langs), block):
        some = langs[first : first + block]
        rows = profiles.where(F.col("lang").isin(some)).collect()
        known = np.unique(np.fromiter((r.gram for r in rows), np.int64, len(rows)))
        ranks = np.full((len(some), len(known)), profile, np.int64)
        for r in rows:
            ranks[some.index(r.lang), np.searchsorted(known, r.gram)] = r.rank

        def run(batches: Iterator[pa.RecordBatch], some: list[str] = some, known: np.ndarray = known, ranks: np.ndarray = ranks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                was = zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True)
                got = [_nearest(t, some, known, ranks, profile) for t in batch.column("text").to_pylist()]
                got = [g if w[0] == "und" or g[1] > w[1] else w for g, w in zip(got, was, strict=True)]
                keep = [c for c in batch.schema.names if c not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

        out = out.mapInArrow(X.tidy(run), out.schema)
        if first + block < len(langs):
            out = X.written(out, "language-scores")  # a task holds one block's profiles
    return out.select(*[f.name for f in schema], "lang_pred", "score")


def identify(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs.

    Profiles come from the rows whose crc32 of doc_id as text does not leave 2 modulo 4
    and whose lang is not null; a null doc_id counts as not held out.  Repeated rows come
    back as often as they came; other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    profiles = X.written(train(docs.where(~held_out(F.col("doc_id"))), profile), "language-profiles")
    return predict(slim, profiles, profile).select("doc_id", "held_out", "lang_pred", "score")
