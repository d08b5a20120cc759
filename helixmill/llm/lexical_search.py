"""Ranked lexical search by branch and bound over document FP-trees (operator 13).

Items come in groups of ITEMS; a group's distinct terms restrict every document to a vector of term counts.  One pass over the
texts writes these vectors and the documents' lengths; Spark sums up how many documents hold each term, from which
the weights follow.  Every task then takes its documents in chunks (CHUNK_DOCS documents, CHUNK_ENTRIES counts) and orders each
vector's terms from the most frequent one, so that vectors share the paths of a trie.  A node that branches holds
the largest count of each term and the least m and doc_id below it.  A score grows with a count and falls with m, so these bound
the score of all documents below.  Each item is searched depth-first, the best child first, leaving out what can't reach its k-th best so far;
that one is carried on from chunk to chunk.  Each task yields its k best documents an item, a window ranks them.

Only an item group's texts and the document counts of its terms pass through the driver.  Any number of items, documents
and terms gives exact results.

Defined results: a null or empty text has no terms and is never a hit; an item without terms has no hits; a null doc_id ranks after
all others of its score; a null item_id is an item like any other; repeated rows, of documents or items, are each their own; without documents or items
the result is empty; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_texts, materialize, text_or_empty

ITEMS = 2000
CHUNK_DOCS = 8192
CHUNK_ENTRIES = 600_000
#: What isn't part of a term becomes a space, A-Z become a-z.
_KEPT = string.digits + string.ascii_lowercase
TO_TERMS = bytes(b if b > 127 or chr(b) in _KEPT else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256))
LAST = 2**63  # above every doc_id


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_TERMS).split()


def term_vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of a document counted with repeats, and how often it holds each of these."""

    def start():
        def make(texts: list[str]):
            n, terms, counts = [], [], []
            for t in texts:
                found = terms_of(t)
                n.append(len(found))
                held = Counter(found)
                mine = sorted((number[x], held[x]) for x in held.keys() & number.keys())
                terms.append([i for i, _ in mine])
                counts.append([c for _, c in mine])
            return n, terms, counts

        return make

    return map_texts(docs.select("doc_id", text_or_empty().alias("text")), start, "n long, terms array<int>, counts array<int>")


class Node:
    """A branch of the trie, or a document: the largest count of each term, the least m and the least doc_id below it."""

    __slots__ = ("children", "first", "m", "most")

    def __init__(self, most: dict[int, int], m: int, first: int, children: list[Node]):
        self.most, self.m, self.first, self.children = most, m, first, children


def above(children: list[Node]) -> Node:
    if len(children) == 1:
        return children[0]
    largest = max(children, key=lambda c: len(c.most))
    most = dict(largest.most)
    for c in children:
        if c is not largest:
            for t, n in c.most.items():
                if n > most.get(t, 0):
                    most[t] = n
    return Node(most, min(c.m for c in children), min(c.first for c in children), children)


def fp_tree(vectors: list[tuple[list[int], Node]]) -> Node:
    """The trie of these documents, each with its terms in order; paths that don't branch have no nodes."""
    vectors.sort(key=lambda v: v[0])
    open_: list[tuple[int, list[Node]]] = [(0, [])]  # depth of a branch, what hangs on it so far
    before: list[int] = []
    last: Node | None = None
    for path, leaf in vectors:
        if last is not None:
            shared = 0
            for a, b in zip(before, path):
                if a != b:
                    break
                shared += 1
            done = last
            while open_[-1][0] > shared:
                _, children = open_.pop()
                children.append(done)
                done = above(children)
            if open_[-1][0] < shared:
                open_.append((shared, []))
            open_[-1][1].append(done)
        before, last = path, leaf
    done = last
    while open_:
        _, children = open_.pop()
        children.append(done)
        done = above(children)
    return done


def bound(node: Node, item: list[tuple[int, int]]) -> int:
    """No document below this node scores more; a document's own bound is its score."""
    most, m, score = node.most, 12 * node.m, 0
    for t, w in item:
        n = most.get(t)
        if n:
            score += w * (1_000_000_000 * n // (1000 * n + m))
    return score


def search(root: Node, item: list[tuple[int, int]], k: int, best: list[tuple[int, int]]) -> None:
    """Adds (score, -doc_id) of the k best documents to a heap that may hold some already."""
    stack = [(bound(root, item), -root.first, root)]
    while stack:
        score, first, node = stack.pop()
        if not score or len(best) == k and (score, first) <= best[0]:
            continue
        if not node.children:
            heapq.heappush(best, (score, first)) if len(best) < k else heapq.heapreplace(best, (score, first))
            continue
        found = [(bound(c, item), -c.first, c) for c in node.children]
        if len(best) == k:
            found = [f for f in found if f[:2] > best[0]]
        found.sort(key=lambda f: f[:2])
        stack += found


def chunks(batches: Iterable[pa.RecordBatch], rank: list[int], length: tuple[int, int]) -> Iterator[list[tuple[list[int], Node]]]:
    """Documents with their terms in the global order, CHUNK_DOCS or CHUNK_ENTRIES at a time."""
    n_docs, n_terms = length
    out, entries = [], 0
    for batch in batches:
        for doc_id, n, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts"))):
            if not terms:
                continue
            first = LAST if doc_id is None else doc_id
            m = 100 - 25 + 25 * n * n_docs // n_terms
            out.append((sorted(rank[t] for t in terms), Node({rank[t]: c for t, c in zip(terms, counts)}, m, first, [])))
            entries += len(terms)
            if len(out) >= CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                yield out
                out, entries = [], 0
    if out:
        yield out


def search_group(docs: DataFrame, items: list[tuple[int | None, str]], k: int) -> DataFrame:
    """(item, doc_id, score) of each task's k best documents for each of these items, item counting from 0."""
    spark = docs.sparkSession
    asked = [Counter(terms_of(text)) for _, text in items]
    number = {t: i for i, t in enumerate(sorted({t for c in asked for t in c}))}
    vectors = materialize(term_vectors(docs, number), "term-vectors")
    n_docs, n_terms = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row per term of the group at most
    order = sorted(range(len(number)), key=lambda t: (-df.get(t, 0), t))
    rank = [0] * len(number)
    for at, t in enumerate(order):
        rank[t] = at
    weight = {rank[t]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    # the heaviest terms first in an item; terms that no document holds add nothing
    wanted = [sorted(((rank[number[t]], c * weight[rank[number[t]]]) for t, c in terms.items() if weight.get(rank[number[t]])), key=lambda x: -x[1]) for terms in asked]

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for chunk in chunks(batches, rank, (n_docs, n_terms)):
            root = fp_tree(chunk)
            for item, heap in zip(wanted, best):
                search(root, item, k, heap)
        for i, heap in enumerate(best):
            if heap:
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([i] * len(heap), pa.int32()), "doc_id": pa.array([None if d == -LAST else -d for _, d in heap], pa.int64()), "score": pa.array([s for s, _ in heap], pa.int64())})

    hits = materialize(vectors.mapInArrow(run, "item int, doc_id long, score long"), "lexical-hits")
    discard(vectors)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = hits.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # ITEMS rows or somewhat more


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, group: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for every row of items (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", text_or_empty().alias("text"))
    groups = asked.count() // group + 1
    dealt = asked.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    out = None
    for g in range(groups):
        mine = [(r.item_id, r.text) for r in dealt.where(F.col("group") == g).select("item_id", "text").orderBy("item_id", "text").collect()]
        if mine:
            found = search_group(docs, mine, k)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
