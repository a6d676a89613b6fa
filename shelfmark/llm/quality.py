"""Quality rules whose thresholds follow the corpus.

Each document gets counts, a fixed base rule, and ratios.  For each language and source
the ratios of the documents that pass the base rule go into quantile sketches: counts in
logarithmic buckets, so a quantile is known to one part in fifty, equal inputs give equal
sketches in whatever order they come, and sketches merge by adding counts.  A sketch of
too few documents is merged up: its language's, then everyone's, speaks for it.  All
thresholds are quantiles of these sketches.  Ratios that most documents have at zero are
cut at an upper quantile, so a rule rejects a stated part of a group at most; mean word
length is fenced on both sides by its quartiles.  Documents are joined with the
thresholds of their language and source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import textops as X

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Bucket i of a sketch holds values of GAMMA**(i-1) to GAMMA**i.
GAMMA = 1.02
#: A sketch of fewer documents is not trusted on its own.
LEAST_DOCS = 50
#: (ratio, its numerator, its denominator, thousandths of a group that pass).
RATIOS = (
    ("symbols", "n_symbols", "n_words", 950),
    ("repeats", "n_repeat_words", "n_words", 990),
    ("dup_lines", "n_dup_lines", "n_lines", 990),
)
#: Mean word length, and how many times the distance of its quartiles the fences stand off.
SHAPE, REACH = ("mean_word", "word_chars", "n_words"), 5.0
#: The bucket of zero.
ZERO = -(2**40)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_counts(texts: list[bytes | None]) -> np.ndarray:
    """A row of COUNTS for each text; n_lines counts the lines with a word."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for a, b in X.chunks(texts):
        part = texts[a:b]
        _, _, h, counts = X.hashed_words(part, X.PLAIN)
        raw = np.frombuffer(b" ".join(t or b"" for t in part), np.uint8)
        bound = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in part])])
        bound[-1] = len(raw)

        def per_text(flag: np.ndarray, bound: np.ndarray = bound) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[bound])

        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        out[a:b, 0] = counts
        out[a:b, 1] = per_text(~space & ((raw & 0xC0) != 0x80))
        out[a:b, 2] = per_text(_SYMBOL[raw])
        owner = np.repeat(np.arange(len(part)), counts)
        sh, at = X.shingles(h, counts, 3)
        if len(sh):
            key = X.mix(sh ^ X.mix(owner[at].astype(np.uint64) + np.uint64(1)))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(h), bool)
            for j in range(3):
                covered[at[twice] + j] = True
            out[a:b, 4] = np.bincount(owner[covered], minlength=len(part))
        for i, t in enumerate(part):
            if t:
                lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else [t] if counts[i] else []
                out[a + i, 5] = len(lines)
                out[a + i, 3] = len(lines) - len(set(lines))
    return out


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct column of COUNTS of the whole text; a null text has none."""
    X.bounded_batches(docs.sparkSession)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = text_counts(X.as_bytes(batch.column("text")))
            struct = pa.StructArray.from_arrays([pa.array(got[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return docs.mapInArrow(X.tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _key(c: str) -> Column:
    """Null shares a group with the empty string."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _ratio(top: str, under: str) -> Column:
    return F.col(top) / F.greatest(F.col(under), F.lit(1))


def _bucket(ratio: Column) -> Column:
    return F.when(ratio > 0, F.ceil(F.log(ratio) / F.log(F.lit(GAMMA)))).otherwise(F.lit(ZERO))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n) of the documents that pass the base rule."""
    ratios = F.array(*[F.struct(F.lit(r).alias("ratio"), _bucket(_ratio(top, under)).alias("bucket")) for r, top, under, *_ in (*RATIOS, SHAPE)])
    return counts.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("lang", "source", F.explode(ratios).alias("x")).groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(*by, ratio, q) of sketches merged by the given columns: q has total and the buckets
    of the quartiles and of the ratio's upper quantile."""
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = W.Window.partitionBy(*by, "ratio")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    at = lambda thousandths: F.min(F.when(1000 * F.col("upto") >= thousandths * F.col("total"), F.col("bucket")))
    upper = F.coalesce(*[F.when(F.col("ratio") == r, F.lit(k)) for r, _, _, k in RATIOS], F.lit(1000))
    q = ranked.groupBy(*by, "ratio").agg(F.max("total").alias("total"), at(250).alias("b25"), at(750).alias("b75"), at(upper).alias("upper"))
    return q.select(*by, "ratio", F.struct("total", "b25", "b75", "upper").alias("q"))


def fences(sketch: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, upper_<ratio>..., low_mean_word, high_mean_word): a row for each
    language and source that has a sketch.  upper is the last bucket that passes."""
    own, lang, every = (_quantiles(sketch, *by).withColumnRenamed("q", name) for name, *by in (("own", "lang", "source"), ("of_lang", "lang"), ("of_all",)))
    joined = own.join(lang, ["lang", "ratio"]).join(every, "ratio")
    chosen = joined.select("lang", "source", "ratio", F.when(F.col("own.total") >= least_docs, F.col("own")).when(F.col("of_lang.total") >= least_docs, F.col("of_lang")).otherwise(F.col("of_all")).alias("q"))
    # A sketch knows a quartile to its bucket: the lower one from there, the upper one to there.
    low, high = F.pow(F.lit(GAMMA), F.col("q.b25") - 1), F.pow(F.lit(GAMMA), F.col("q.b75"))
    spread = REACH * (high - low)
    this = lambda r, c: F.max(F.when(F.col("ratio") == r, c))
    uppers = [this(r, F.col("q.upper")).alias(f"upper_{r}") for r, *_ in RATIOS]
    return chosen.groupBy("lang", "source").agg(*uppers, this("mean_word", low - spread).alias("low_mean_word"), this("mean_word", high + spread).alias("high_mean_word"))


def _good(count: Callable[[str], Column], limit: Callable[[str], Column]) -> Column:
    """Whether a document's counts keep to its group's thresholds; null without a group."""
    ratio = lambda top, under: count(top) / F.greatest(count(under), F.lit(1))
    shape = ratio(*SHAPE[1:])
    ok = (shape >= limit("low_mean_word")) & (shape <= limit("high_mean_word"))
    for r, top, under, _ in RATIOS:
        ok = ok & (_bucket(ratio(top, under)) <= limit(f"upper_{r}"))
    return ok


def _judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts joined with the thresholds of their language and source, with base_failed and
    kept.  A language and source without a sketch has failed documents alone."""
    # Thresholds are a row for each language and source; beyond this many the join shuffles.
    few = limits.count() <= 20_000
    joined = counts.join(F.broadcast(limits) if few else limits, ["lang", "source"], "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(_good(F.col, F.col), F.lit(False)))


def _plain_counts(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key("lang").alias("lang"), _key("source").alias("source"), F.col("text").cast("string").alias("text"))
    return with_counts(slim, "counts").select("doc_id", "lang", "source", "counts.*")


def verdicts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Words are runs of other characters than space and \\x09-\\x0D.  A null or empty text
    has no words, so it fails the base rule.  Null and empty languages (sources) form one
    group.  Repeated rows are judged each; columns other than doc_id, text, lang and
    source are ignored; an empty table gives no rows.
    """
    counts = X.written(_plain_counts(docs), "quality-counts")
    limits = X.written(fences(sketches(counts), least_docs), "quality-fences")
    return _judged(counts, limits).select("doc_id", *COUNTS[:-1], "base_failed", "kept")


def keep_good(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of docs that verdicts() keeps, all columns as they were.  Texts are
    read twice instead of being shuffled or written.  A null or empty text fails the base
    rule, so its row goes; null and empty languages (sources) form one group; repeated
    rows stay or go together, and so do documents with equal counts in one group; an
    empty table gives no rows; further columns pass through, whatever their names."""
    counts = _plain_counts(docs)
    limits = X.written(fences(sketches(counts), least_docs), "quality-fences")
    own = "_shelfmark_counts"
    while own in docs.columns:
        own += "_"
    row = with_counts(docs, own)
    n = lambda c: F.col(f"{own}.{c}")
    few = limits.count() <= 20_000
    lim = limits.select(F.struct("*").alias(f"{own}_f"))
    f = lambda c: F.col(f"{own}_f.{c}")
    joined = row.join(F.broadcast(lim) if few else lim, (_key("lang") == f("lang")) & (_key("source") == f("source")), "left")
    return joined.where(~base_failed(n("n_words"), n("n_repeat_words")) & _good(n, f)).select(*[F.col(f"`{c}`") for c in docs.columns])
