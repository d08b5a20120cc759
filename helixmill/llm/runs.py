"""Periodic runs of words by maximal pairs of a suffix array's LCP intervals (operator 11).

A run is a stretch of words with smallest period q that no neighbouring word extends.  Two suffixes q apart whose longest
common prefix is l, with different words to their left, are a maximal pair: the stretch of q + l words from the first of
them has period q and can't be extended.  Runs of exponent e are therefore exactly the maximal pairs with l >= (e - 1) q; of pairs
that name one stretch the least period counts.

Texts are taken in chunks of CHUNK_WORDS words (a longer text alone); words get numbers of their own in each text and every
text ends with a number found once, so no repeat crosses texts.  Prefix doubling sorts the suffixes, dropping
those that are unique so far; longest common prefixes are counted in text order.  Intervals of the LCP array are visited bottom-up, each
holding its positions in lists by the word to the left.  Where two subtrees meet, the smaller one's positions look into the
larger one's lists of other words, within the distance that the common prefix allows, and are then merged into them.
Groups of suffixes with no two positions near enough for their longest common prefix are left out beforehand.

Everything happens within a row: no shuffle, and memory grows with one chunk or one text.

Defined results: a null or empty text, or one without words, has no words and no runs; a null doc_id is a row like any
other; repeated rows get the same result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_or_empty

CHUNK_WORDS = 400_000
RUN = "struct<start: long, length: long, period: long>"


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, each text's own and followed by one found nowhere else; where each text starts."""
    codes, starts, base = [], [], 0
    for words in texts:
        starts.append(len(codes))
        own: dict[bytes, int] = {}
        codes += [base + own.setdefault(w, len(own)) for w in words]
        base += len(own)
        codes.append(base)
        base += 1
    return np.array(codes, np.int64), np.array(starts, np.int64)


def repeated_suffixes(s: np.ndarray, least: int) -> np.ndarray:
    """Positions of suffixes whose first words (the largest power of two up to least) stand elsewhere too, in the order of the suffixes."""
    if not len(s):
        return s
    count = np.bincount(s)
    rank = (np.cumsum(count) - count)[s]
    live, h, kept = np.flatnonzero(count[s] > 1), 1, None
    while len(live):
        if kept is None and 2 * h > least:
            kept = live
        key = rank[live] * len(s) + rank[live + h]  # a live suffix has more than h words
        order = np.argsort(key)
        live, key = live[order], key[order]
        old = rank[live]
        new_key, new_old = np.r_[True, key[1:] != key[:-1]], np.r_[True, old[1:] != old[:-1]]
        at = np.arange(len(live))
        first = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[live] = old + first - np.maximum.accumulate(np.where(new_old, at, 0))
        alone = new_key & np.r_[new_key[1:], True]
        live, h = live[~alone], 2 * h
    if kept is None:
        return live
    return kept[np.argsort(rank[kept])]


def common_prefixes(s: list[int], order: np.ndarray, least: int) -> np.ndarray:
    """Longest common prefix of each of these suffixes with the one before it, counted in text order.

    The next suffix shares one word less with the one before it at least, where that keeps it among the repeated ones."""
    kept = 1 << least.bit_length() - 1
    before, out = dict(zip(order[1:].tolist(), order[:-1].tolist())), {}
    last, n = -2, 0
    for i in np.sort(order[1:]).tolist():
        n = n - 1 if i == last + 1 and n > kept else 0
        j = before[i]
        while s[i + n] == s[j + n]:  # the numbers that end texts differ
            n += 1
        out[i], last = n, i
    return np.array([0, *[out[i] for i in order[1:].tolist()]], np.int64)


def groups_worth_visiting(order: np.ndarray, lcp: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of the suffix array with common prefixes of least words or more that hold two positions near enough for a run."""
    inside = lcp >= least
    number = np.cumsum(~inside) - 1
    by_place = np.lexsort((order, number))
    gap = np.diff(order[by_place])
    same = np.diff(number[by_place]) == 0
    nearest = np.full(number[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(nearest, number[by_place][1:][same], gap[same])
    longest = np.zeros(number[-1] + 1, np.int64)
    np.maximum.at(longest, number[inside], lcp[inside])
    starts = np.flatnonzero(~inside)
    ends = np.r_[starts[1:], len(order)]
    return [(int(starts[k]), int(ends[k])) for k in np.flatnonzero(nearest <= longest // times)]


class Subtree:
    """Positions below a node, in sorted lists by the word to their left."""

    __slots__ = ("lists", "size")

    def __init__(self, left: int, position: int):
        self.lists, self.size = {left: [position]}, 1


def meet(a: Subtree, b: Subtree, l: int, s: list[int], times: int, min_length: int, found: dict) -> Subtree:
    """Reports the maximal pairs between two subtrees whose suffixes share l words, then merges the smaller into the larger."""
    if a.size < b.size:
        a, b = b, a
    reach = l // times
    for left, places in b.lists.items():
        for x in places:
            low, high = x - reach, x + reach
            if len(a.lists) <= 2 * reach:
                others = [y for other, ys in a.lists.items() if other != left for y in ys[bisect_left(ys, low) : bisect_left(ys, high + 1)]]
            else:  # fewer places than lists
                others = []
                for y in range(max(low, 0), high + 1):
                    other = s[y - 1] if y <= len(s) else -1
                    ys = a.lists.get(other) if other != left else None
                    if ys and (k := bisect_left(ys, y)) < len(ys) and ys[k] == y:
                        others.append(y)
            for y in others:
                q = abs(x - y)
                if q + l >= min_length:
                    key = (min(x, y), q + l)
                    found[key] = min(q, found.get(key, q))
    for left, places in b.lists.items():
        mine = a.lists.get(left)
        if mine is None:
            a.lists[left] = places
        elif len(places) * 16 < len(mine):
            for x in places:
                insort(mine, x)
        else:
            mine += places
            mine.sort()
    a.size += b.size
    return a


def maximal_pairs(s: list[int], order: list[int], lcp: list[int], times: int, min_length: int, found: dict) -> None:
    """Visits the LCP intervals of one stretch of the suffix array bottom-up."""
    open_: list[tuple[int, Subtree]] = []
    done = Subtree(s[order[0] - 1], order[0])
    for position, l in zip(order[1:], lcp[1:]):
        while open_ and open_[-1][0] > l:
            depth, subtree = open_.pop()
            done = meet(subtree, done, depth, s, times, min_length, found)
        if open_ and open_[-1][0] == l:
            done = meet(open_.pop()[1], done, l, s, times, min_length, found)
        open_.append((l, done))
        done = Subtree(s[position - 1], position)
    while open_:
        depth, subtree = open_.pop()
        done = meet(subtree, done, depth, s, times, min_length, found)


def runs_of(texts: list[list[bytes]], min_length: int = 6, min_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and period."""
    times = min_exponent - 1
    least = min(max(min_length - q, times * q) for q in range(1, min_length + 1))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    codes, starts = numbered(texts)
    order = repeated_suffixes(codes, least)
    if not len(order):
        return out
    s = codes.tolist()  # s[-1] ends the last text, so it is a word found nowhere else to the left of position 0
    lcp = common_prefixes(s, order, least)
    found: dict[tuple[int, int], int] = {}
    for a, b in groups_worth_visiting(order, lcp, least, times):
        maximal_pairs(s, order[a:b].tolist(), lcp[a:b].tolist(), times, min_length, found)
    for (start, length), q in found.items():
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[k].append((start - int(starts[k]), length, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of each run only the first period stays."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def word_runs(docs: DataFrame, text: Column | None = None, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period by start and period), collapsed (the words
    that no run repeats, joined by one space).  text: an expression to take instead of the column text.  min_exponent is a whole number of 2 or more."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs need a length and an exponent of 2 or more")

    def start():
        def make(batch: list[str]):
            n_words, runs, rest = [], [], []
            chunk: list[list[bytes]] = []
            size = 0

            def flush():
                nonlocal size
                for words, found in zip(chunk, runs_of(chunk, min_length, min_exponent), strict=True):
                    n_words.append(len(words))
                    runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                    rest.append(collapsed(words, found).decode())
                chunk.clear()
                size = 0

            for t in batch:
                words = t.encode().split()  # bytes are split at the six ASCII white spaces
                if chunk and size + len(words) > CHUNK_WORDS:
                    flush()
                chunk.append(words)
                size += len(words)
            flush()
            return n_words, runs, rest

        return make

    rows = docs.select("doc_id", (text_or_empty() if text is None else F.coalesce(text, F.lit(""))).alias("text"))
    return map_texts(rows, start, f"n_words long, runs array<{RUN}>, collapsed string")


def with_periods(words: Column, doc_id: Column) -> Column:
    """The text of these words, made periodic from some word on in every tenth document by the checksum of its id."""
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " "))


def run_digests(runs: DataFrame) -> DataFrame:
    """The columns of the query: the longest run, and digests of all runs and of the collapsed text."""
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = runs.select("doc_id", "runs", "collapsed", best.alias("best"), text.alias("lines"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
