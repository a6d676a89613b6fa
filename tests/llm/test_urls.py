"""Verdicts against a plain version of rules, segmentation and naive Bayes."""

import random
import re
from collections import Counter
from itertools import combinations
from math import isclose, log

from shelfmark.llm import urls as U

LOWER = str.maketrans(U._UPPER, U._LOWER)


def corpus():
    rnd = random.Random(2)
    vocabulary = ["blue", "horse", "casino", "news", "free", "win", "a", "b"]
    rows = [(0, None, None), (1, "", "x"), (2, "no scheme/here", None), (3, "http://", ""), (4, "HTTP://EXAMPLE.com:80/en/?q#f", "<p>Win</p>"), (5, "x://a.example.com#://y/z", "<script>win</script>"), (6, "a://" + "blue" * 40 + ".com/en/1", "blue horse")]
    for i in range(7, 200):
        host = f"{rnd.choice(vocabulary)}{rnd.choice(vocabulary)}.{rnd.choice(['example.', '', 'www.'])}{rnd.choice(['com', 'net', 'org', 'io'])}"
        path = f"/{rnd.choice(['en', 'de', 'es', 'fr'])}/{rnd.choice(['7', '81', 'free-win', ''])}{rnd.choice(['', '?x=/en/', '#top'])}"
        rows.append((i, f"https://{host}{path}", f"<b>{' '.join(rnd.choices(vocabulary, k=9))}</b>"))
    return [*rows, rows[20], (None, rows[21][1], None)]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def tokens(host, path, counts, total):
    out = []
    for label in host.split("."):
        out += ["host:" + p for p in U.best_split(label, counts, total)]
    for t in re.split(r"[\W_]+", path.lower()):
        if t:
            out.append(f"path:#{len(t)}" if t.isdigit() else "path:" + t)
    return out


def test_against_plain_version(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    got = U.verdicts(df).collect()
    assert len(got) == len(rows)
    counts = Counter(w for _, _, h in rows for w in re.findall(r"[a-z]+", re.sub(r"<script.*?</script>|<[^>]*>", " ", h or "").lower()))
    total, seen, kinds = sum(counts.values()), {"block": Counter(), "allow": Counter()}, Counter()
    for _, url, _ in rows:
        _, v = rule_of(*parts(url))
        if v:
            kinds[v] += 1
            seen[v].update(tokens(*parts(url), counts, total))
    size = len(seen["block"] | seen["allow"])
    weight = {t: log((seen["block"][t] + 1) / (seen["block"].total() + size + 1)) - log((seen["allow"][t] + 1) / (seen["allow"].total() + size + 1)) for t in seen["block"] | seen["allow"]}
    want = {}
    for i, url, _ in rows:
        host, path = parts(url)
        rule, v = rule_of(host, path)
        score = log(kinds["block"] / kinds["allow"]) + sum(weight.get(t, 0) for t in tokens(host, path, counts, total))
        want[i] = (host, path, rule, v or ("block" if round(score, 9) > 0 else "allow"), score)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id][:4]
        assert isclose(r.score, want[r.page_id][4], abs_tol=1e-8)
    assert U.verdicts(df.limit(0)).collect() == []
    assert {r.verdict for r in U.verdicts(df, (("none", "/", "block"),)).collect()} == {"allow"}


def test_best_split_is_the_best():
    counts = {"ab": 5, "a": 3, "b": 2, "bc": 9, "c": 1, "abc": 1}
    total = sum(counts.values())

    def cost(w):
        return log(total + 1) - log(counts[w]) if w in counts else log(total + 1) + len(w) * log(26)

    long = "x" * 30
    counts[long] = 4
    assert U.best_split("ab" + long + "zab", counts, total) == ["ab", long, "z", "ab"]
    assert U.best_split("q" * 90, counts, total) == ["q" * 90]
    for label in ["abc", "abcabc", "xbcx", "cab", "zz", "a"]:
        ways = [[label[i:j] for i, j in zip((0, *c), (*c, len(label)), strict=True)] for n in range(len(label)) for c in combinations(range(1, len(label)), n)]
        best = min(sum(map(cost, w)) for w in ways)
        assert isclose(sum(map(cost, U.best_split(label, counts, total))), best)
    assert U.best_split("", counts, total) == []


def test_words_and_labels_of_any_length(spark):
    """A word of over KEY letters is found by its first ones, in labels of over 63."""
    long = "donaudampfschifffahrtsgesellschaft"
    words = spark.createDataFrame([(long, 3), (long[:25], 1), ("blue", 2), (long[:20], 1)], "word string, n long")
    label = "blue" * 20 + long
    got = U.segmented(spark.createDataFrame([(label,), ("",)], "label string"), words).collect()
    assert {r.label: r.parts for r in got} == {label: ["blue"] * 20 + [long], "": []}
