"""Periodic runs against their definition."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from helixmill.llm import queries, runs


def brute(words, min_length=6, exponent=4):
    """Every stretch that has period q and can't be extended, by its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                best[(i, j + q - i)] = min(q, best.get((i, j + q - i), q))
            i = max(j, i + 1) if j == i else j
    return sorted((s, length, q) for (s, length), q in best.items())


def texts():
    r = random.Random(5)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, list("abababab"), list("xaaaaaay"), ["a"] * 300, list("aab" * 40), list("ab" * 9 + "c" + "ab" * 9)]
    for _ in range(300):
        k, n = r.choice([1, 2, 2, 3, 5]), r.randrange(80)
        out.append([r.choice("abcde"[:k]) for _ in range(n)])
    for _ in range(60):  # periodic parts in ordinary text, one inside another
        unit = [r.choice("abcdefgh") for _ in range(r.randrange(1, 9))]
        inner = unit * r.randrange(2, 7)
        out.append([r.choice("abcdefgh") for _ in range(r.randrange(20))] + (inner + ["z"]) * r.randrange(1, 6) + unit[: r.randrange(len(unit) + 1)])
    return out


@pytest.mark.parametrize(("min_length", "exponent"), [(6, 4), (2, 2), (9, 3), (3, 5)])
def test_runs_are_the_definitions(min_length, exponent):
    words = texts()
    got = runs.runs_of([[w.encode() for w in t] for t in words], min_length, exponent)
    assert got == [sorted(brute(t, min_length, exponent), key=lambda x: (x[0], x[2])) for t in words]
    assert sum(map(len, got)) > 20


def test_long_periodic_texts_are_quick():
    r = random.Random(6)
    unit = [b"%d" % r.randrange(10**6) for _ in range(1000)]
    assert runs.runs_of([[b"a"] * 200_000, unit * 100, [r.choice([b"a", b"b"]) for _ in range(50_000)]])[:2] == [[(0, 200_000, 1)], [(0, 100_000, 1000)]]


def planted(doc_id, text):
    ws, h = (text or "").split(" ") if text else [], zlib.crc32(str(doc_id).encode())
    ws = [w for w in ws if w]
    g, n = h // 10, len(ws)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    return ws


def test_query_is_brute_force(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["x", "y", "word"]) if r.random() < 0.5 else f"w{r.randrange(9)}" for _ in range(r.randrange(120)))) for i in range(150)] + [(150, None), (151, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(rows) and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in got)
    for i, text in rows:
        ws = planted(i, text)
        found = brute(ws)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda x: (x[0], x[2])))), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))
        x = got[i]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == want, i


def test_odd_rows(spark):
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \t\n\x0b"), (4, "x " * 20_000), (4, "x " * 20_000), (5, "é é " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("runs", "n_words", "collapsed", "words")})
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.word_runs(df).collect()))
    one = (4, 20_000, [(0, 20_000, 1)], "x")
    assert got == [(0, 7, [(0, 7, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), one, one, (5, 9, [(0, 9, 1)], "é é")]
    assert runs.word_runs(df.limit(0)).count() == 0
