"""URL verdicts by rules, and by naive Bayes over segmented host names.

Host labels such as `bluehorse` are split into words by Viterbi search under a unigram
model, counted over the words of all pages.  Only the parts of distinct labels are looked
up, by a join, so the word table is never broadcast.  URLs that a rule decides are the
training rows of a multinomial naive Bayes model over host words and path tokens, which
judges the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X

#: (host, path, verdict) of the rules.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Letters by which words are looked up; longer words are found by their first ones.
KEY = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every row; a null url or one without :// has both empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1).alias("path"))


def ruled(parts: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Distinct (host, path) with rule and ruling, the longest rule that fits; null where
    none does.  Rules are joined on the host and its parent domains."""
    table = parts.sparkSession.createDataFrame([(h, p, v, h + p) for h, p, v in rules], "rule_host string, rule_path string, ruling string, rule string")
    distinct = parts.select("host", "path").distinct()
    label = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    hits = distinct.select("host", "path", F.explode(domains).alias("rule_host")).join(table, "rule_host").where(F.startswith("path", F.col("rule_path")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruling")).alias("best"))
    return distinct.join(best, ["host", "path"], "left").select("host", "path", "best.rule", "best.ruling")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters in the texts of all pages."""
    text = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return words.where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words that make up label.  An unknown part costs as a word seen
    once, and as much again for each of its characters as a random letter.  Equal splits
    go to the longer last word."""
    unit, letter = log(total + 1), log(26)
    sizes = sorted({len(w) for w in counts}, reverse=True)
    cost, back, rest = [0.0], [0], (0.0, 0)
    for i in range(1, len(label) + 1):
        best = unit + rest[0] + i * letter, rest[1]
        for m in sizes:
            n = counts.get(label[i - m : i]) if m <= i else None
            if n:
                best = min(best, (cost[i - m] + unit - log(n), i - m))
        cost.append(best[0])
        back.append(best[1])
        rest = min(rest, (best[0] - i * letter, i))
    out, i = [], len(label)
    while i:
        out.append(label[back[i] : i])
        i = back[i]
    return out[::-1]


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, parts) of distinct labels, of any length.  The parts of a label that have up
    to KEY letters are looked up, so a label asks for a number linear in its length; a
    longer word answers to its first KEY letters, if the label holds it."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    starts = F.when(F.length("label") > 0, F.sequence(F.lit(1), F.length("label"))).otherwise(F.array())
    subs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("label") - i + 1)), lambda n: F.substr("label", i, n))))
    asked = labels.select("label", F.explode_outer(F.array_distinct(subs)).alias("key"))
    table = words.select(F.substring("word", 1, KEY).alias("key"), "word", "n")
    held = F.when(F.contains("label", "word"), F.struct("word", "n"))
    known = asked.join(table, "key", "left").groupBy("label").agg(F.collect_list(held).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_pylist()
            parts = [best_split(x, {w["word"]: w["n"] for w in k}, total) for x, k in zip(label, batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(parts, pa.list_(pa.string()))], names=["label", "parts"])

    return known.mapInArrow(run, "label string, parts array<string>")


def _path_tokens(path: Column) -> Column:
    """Runs of letters and digits, lower-cased; a number counts by its number of digits."""
    token = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.when(t.rlike(r"^[0-9]+$"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t))
    return F.transform(token, lambda t: F.concat(F.lit("path:"), t))


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages.

    score is the model's log odds of block; the verdict is the rule's, else block where
    the score is over 0.  Without training rows of both kinds all scores are 0.  Rows
    with equal host and path get equal verdicts; a null page_id stays null; other columns
    but html are ignored, and a null html has no words; an empty table gives no rows.
    """
    spark = pages.sparkSession
    X.bounded_batches(spark)
    parts = with_parts(pages)
    urls = X.written(ruled(parts, rules), "urls")
    words = X.written(word_counts(pages), "words")
    hosts = urls.select("host").distinct()
    labels = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).distinct()
    split = X.written(segmented(labels, words), "labels")
    host_tokens = hosts.select("host", F.explode(F.split("host", r"\.")).alias("label")).join(split, "label").select("host", F.explode("parts").alias("t")).select("host", F.concat(F.lit("host:"), "t").alias("token"))
    host_bags = X.written(host_tokens.groupBy("host", "token").agg(F.count("*").alias("k")), "hosts")
    path_bags = urls.select("host", "path", "ruling", F.explode(_path_tokens(F.col("path"))).alias("token"))
    # Rows of each host and ruling first, so a host's words are joined once, not by row.
    weight = parts.groupBy("host", "path").agg(F.count("*").alias("rows")).join(urls.where("ruling is not null"), ["host", "path"])
    of_host = weight.groupBy("host", "ruling").agg(F.sum("rows").alias("rows")).join(host_bags, "host").select("token", "ruling", (F.col("rows") * F.col("k")).alias("n"))
    of_path = weight.select("rows", "ruling", F.explode(_path_tokens(F.col("path"))).alias("token")).select("token", "ruling", F.col("rows").alias("n"))
    counts = X.written(of_host.unionByName(of_path).groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("ruling") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("block", "allow")]), "tokens")
    total = counts.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("block", "allow")], F.count("*").alias("v")).first()
    taught = {r.ruling: r.n for r in weight.groupBy("ruling").agg(F.sum("rows").alias("n")).collect()}
    able = len(taught) == 2
    odds = counts.select("token", (F.log((F.col("block") + 1) / F.lit(total.block + total.v + 1)) - F.log((F.col("allow") + 1) / F.lit(total.allow + total.v + 1))).alias("w"))
    odds = F.broadcast(odds) if total.v <= 50_000 else odds
    host_score = host_bags.join(odds, "token").groupBy("host").agg(F.sum(F.col("k") * F.col("w")).alias("hs"))
    path_score = path_bags.join(odds, "token").groupBy("host", "path").agg(F.sum("w").alias("ps"))
    prior = log(taught["block"] / taught["allow"]) if able else 0.0
    odds_of = F.round(F.lit(prior) + F.coalesce("hs", F.lit(0.0)) + F.coalesce("ps", F.lit(0.0)), 9) if able else F.lit(0.0)
    judged = urls.join(host_score, "host", "left").join(path_score, ["host", "path"], "left").select("host", "path", "rule", "ruling", odds_of.alias("score"))
    return parts.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
