"""Components against a plain search: chains, stars, repeats, loops and nulls."""

import random

from shelfmark.llm.graph import components


def plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = start
                stack.extend(near[x])
    return out


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    rnd.shuffle(chain)
    star = [(5000, 5000 + i) for i in range(1, 400)]
    loose = [(rnd.randrange(10**6, 10**6 + 600), rnd.randrange(10**6, 10**6 + 600)) for _ in range(300)]
    edges = [*chain, *star, *loose, *loose[:20], (7, 7), (None, 3), (4, None), (-5, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == plain(edges)
    assert components(df.limit(0)).collect() == []
