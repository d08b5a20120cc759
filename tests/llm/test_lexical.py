"""Ranked search against scoring every document; the tree's bounds; odd rows."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from helixmill.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def brute(docs, items, k=20):
    held = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := terms(t))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item_id, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def check(spark, docs, items, **options):
    got = ls.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, items, options.get("k", 20)), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"{'éß'[i % 2] if i % 9 == 0 else ''}t{i}" for i in range(200)]
    pick = lambda: vocabulary[min(int(r.expovariate(0.04)), 199)]
    text = lambda: "".join((w.upper() if r.random() < 0.2 else w) + r.choice([" ", ", ", "\n", "-"]) for w in (pick() for _ in range(r.choice([0, 1, 5, 30, 120]))))
    return r, text, [(i * 7 % 1009, text()) for i in range(n)]


def test_ranks_are_brute_force(spark, monkeypatch):
    r, text, docs = corpus(1, 400)
    docs += [(2000 + i, docs[5][1] + " t3 t190") for i in range(60)] + [(3, None), (4, "")]  # copies and ties
    items = [(i, text()) for i in range(12)] + [(20, "t3 t3 T190"), (21, "nowhere"), (22, None), (23, "t199 t198")]
    check(spark, docs, items)
    check(spark, docs, items, k=3, group=4)
    monkeypatch.setattr(ls, "CHUNK_DOCS", 17)  # many trees, also with local threads only
    rank = list(range(200))
    number = {f"t{i}".encode(): i for i in range(200)}
    rows = [(d, len(ls.terms_of(t)), Counter(x for x in ls.terms_of(t) if x in number)) for d, t in docs if t]
    nodes = [(sorted(rank[number[x]] for x in c), ls.Node({number[x]: n for x, n in c.items()}, 75 + n, d, [])) for d, n, c in rows if c]
    root = ls.fp_tree(list(nodes))
    leaves, stack = [], [root]
    while stack:
        node = stack.pop()
        for child in node.children:
            assert child.m >= node.m and child.first >= node.first and all(n <= node.most[t] for t, n in child.most.items())
        stack += node.children
        leaves += [] if node.children else [node]
    assert len(leaves) == len(nodes)
    item = [(3, 5), (10, 7), (60, 900)]
    heap = []
    ls.search(root, item, 9, heap)
    assert sorted(heap) == sorted((ls.bound(leaf, item), -leaf.first) for _, leaf in nodes)[-9:]


def test_odd_rows(spark):
    long = "word " * 60_000 + "rare"
    docs = [(None, "rare word"), (1, None), (2, ""), (3, long), (4, "Rare WORD"), (4, "rare word"), (5, "--- \n"), (None, "rare word")]
    check(spark, docs, [(1, "rare"), (1, "rare"), (None, "word rare"), (2, ""), (3, None)])
    check(spark, docs, [])
    check(spark, [], [(1, "rare")])
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("n", "terms", "counts", "item", "rank", "score", "group")})
    items = spark.createDataFrame([(1, "rare")], "item_id long, text string").withColumns({c: F.lit("z") for c in ("group", "item", "rank")})
    got = ls.ranked_search(df, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 5
