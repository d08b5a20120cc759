"""Mixing overlapping sources to target weights by min-cost flow (operator 5).

Documents are aggregated by membership pattern (the set of sources they belong to).  A flow network sends each
pattern's words to the quotas of its sources; a pattern's capacity comes in layers, one per repetition, whose costs
rise (convex), so nothing repeats before the first copies are used up.  The network has a node per pattern and source
and is solved on the driver; only these sums reach it.  Within a pattern, whole repetitions go to every document and
the rest to documents in seeded hash order.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; repeated rows are separate
documents; documents of size 0 take 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, row_key, text_or_empty, unused

#: Seeded order is by md5 of "seed:doc_id"; its first three digits make 4096 bins per pattern.
BIN_DIGITS = 3
#: Sums by pattern are broadcast up to so many patterns, and joined by a shuffle beyond.
#: Only sums by membership pattern reach the driver; more patterns than this are refused.
MAX_PATTERNS = 200_000
BROADCAST_PATTERNS = 20_000


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def share_targets(sizes: list[int], weights: list[int], limit: int = 3) -> list[float]:
    """Shares of the total by weight; none above limit times its size, the excess going to the others by weight.

    In order of size per weight, sources are at their limit while what is left would give them more than it.
    """
    order = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    targets, left, heavy = [0.0] * len(sizes), sum(sizes), sum(weights)
    for at, i in enumerate(order):
        if left * weights[i] <= limit * sizes[i] * heavy:
            for j in order[at:]:
                targets[j] = float(left * weights[j]) / heavy
            break
        targets[i] = float(limit * sizes[i])
        left, heavy = left - limit * sizes[i], heavy - weights[i]
    return targets


def _augment(edges: list[tuple[int, int, int]], n: int, cap: list[int], start: int, end: int) -> None:
    """Raises the flow from start to end as far as it goes, by blocking flows along shortest paths.

    Edge e leads from edges[e // 2] one way (e even) or back (e odd); cap holds what each may still take and is changed.
    """
    to, out = [0] * (2 * len(edges)), [[] for _ in range(n)]
    for k, (u, v, _) in enumerate(edges):
        to[2 * k], to[2 * k + 1] = v, u
        out[u].append(2 * k)
        out[v].append(2 * k + 1)
    while True:
        level, layer = {start: 0}, [start]
        while layer and end not in level:
            beyond = []
            for u in layer:
                for e in out[u]:
                    if cap[e] and to[e] not in level:
                        level[to[e]] = level[u] + 1
                        beyond.append(to[e])
            layer = beyond
        if end not in level:
            return
        tried, path, at = dict.fromkeys(level, 0), [], start
        while True:
            if at == end:
                amount = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= amount
                    cap[e ^ 1] += amount
                full = next(k for k, e in enumerate(path) if not cap[e])
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if cap[e] and level.get(to[e]) == level[at] + 1:
                    path.append(e)
                    at = to[e]
                    break
                tried[at] += 1
            else:
                if not path:
                    break
                at = to[path.pop() ^ 1]
                tried[at] += 1


def min_cost_flow(patterns: list[tuple[int, list[int]]], quotas: list[int], layers: int = 3) -> list[dict[int, int]]:
    """patterns: (words, sources); quotas: words by source.  Words that each pattern sends to each of its sources.

    The k-th repetition of a word costs k, whatever the pattern, so that all paths of one layer cost the same: shortest paths first means the largest flow with
    every word once, raised to the largest with every word twice, and so on.  A path that raises the flow never takes words back from a
    pattern, so earlier layers stay full.  Each layer is one maximum flow by blocking flows, nearly linear in the patterns.
    """
    n = len(patterns)
    start, end = n + len(quotas), n + len(quotas) + 1
    edges = [(start, p, 0) for p in range(n)] + [(n + s, end, q) for s, q in enumerate(quotas)]
    links = [(p, s) for p, (_, sources) in enumerate(patterns) for s in sources]
    edges += [(p, n + s, layers * patterns[p][0]) for p, s in links]
    cap = [x for _, _, c in edges for x in (c, 0)]
    for _ in range(layers):
        for p, (size, _) in enumerate(patterns):
            cap[2 * p] += size
        _augment(edges, end + 1, cap, start, end)
    first = 2 * (n + len(quotas)) + 1
    flow: list[dict[int, int]] = [{} for _ in patterns]
    for k, (p, s) in enumerate(links):
        flow[p][s] = cap[first + 2 * k]
    return flow


def mix_sources(docs: DataFrame, sources: Column | None = None, weights=(5, 2, 1), limit: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, sources, size, source_size, target, taken.

    ``sources`` is an array of the sources a document belongs to; by default its own source alone.  source_size and
    target are those of its first source.  Each pattern's taken words differ from its flow by less than the size of
    the document that would cross it, less still when another document fits the gap better.
    """
    spark = docs.sparkSession
    if sources is None:
        sources = F.array(F.col("source").cast("string"))
    rows = docs.select(
        "doc_id", *keep, word_count().alias("size"), sources.alias("sources"), F.monotonically_increasing_id().alias("row"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    rows = materialize(rows.withColumn("pattern", F.to_json(F.struct(F.array_sort("sources").alias("s")), {"ignoreNullFields": "false"})), "mix-rows")
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.any_value("sources").alias("sources")).orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group sources first")
    names = sorted({s for r in sums for s in r.sources}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in sums:
        for s in set(r.sources):
            sizes[at[s]] += r.words
    total = sum(r.words for r in sums)
    targets = share_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], limit) if total else [0.0] * len(names)
    flow = min_cost_flow([(r.words, sorted({at[s] for s in r.sources})) for r in sums], [int(t + 0.5) for t in targets], limit)
    plan = []
    for r, f in zip(sums, flow, strict=True):
        sent, first = sum(f.values()), at[r.sources[0]] if r.sources else 0
        full = sent // r.words if r.words else 0
        plan.append((r.pattern, full, sent - full * r.words, sizes[first], targets[first]))
    small = F.broadcast if len(plan) <= BROADCAST_PATTERNS else (lambda df: df)  # what follows has a row per pattern at most
    plan = small(spark.createDataFrame(plan, "pattern string, full long, rest long, source_size long, target double"))

    # seeded order without one long sort: sums by bin, running sums over bins, and a running sum within the bin that crosses
    bins = rows.withColumn("bin", F.substring("key", 1, BIN_DIGITS)).groupBy("pattern", "bin").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("words").over(over)).join(plan, "pattern")
    edge = bins.where("upto > rest AND upto - words <= rest").select("pattern", F.col("bin").alias("edge"), (F.col("upto") - F.col("words")).alias("before"))
    edge = small(materialize(edge, "mix-edges"))
    rows = rows.join(plan, "pattern").join(edge, "pattern", "left").withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    inside = rows.where("bin = edge")
    within = Window.partitionBy("pattern").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(within))
    fits = materialize(inside.where("upto <= rest").select("pattern", "row", "upto"), "mix-inside")
    gap = fits.groupBy("pattern").agg(F.max("upto").alias("reached"))
    chosen = rows.join(fits.select("row", F.lit(True).alias("fits")), "row", "left").join(small(gap), "pattern", "left")
    chosen = chosen.withColumn("extra", F.expr("coalesce(bin < edge, true) OR coalesce(fits, false)")).withColumn("gap", F.expr("rest - coalesce(reached, before, rest)"))
    # one more document where its size comes nearer the gap than nothing does
    filler = chosen.where("NOT extra AND abs(size - gap) < gap").groupBy("pattern").agg(F.min(F.struct(F.expr("abs(size - gap)").alias("off"), "key", "doc_id", "size", "row")).alias("f"))
    filler = small(materialize(filler.select("pattern", F.col("f.row").alias("filler")), "mix-fill"))
    chosen = chosen.join(filler, "pattern", "left")
    taken = F.expr("size * (full + CASE WHEN rest > 0 AND (extra OR coalesce(row = filler, false)) THEN 1 ELSE 0 END)")
    return chosen.select("doc_id", *keep, "sources", "size", "source_size", "target", taken.alias("taken"))


def repeat_mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with all their columns, each as many times as the mix takes it; those not taken go.

    Documents are joined with their plan by doc_id and text; rows that repeat both are equal and share what they take.
    """
    key, times, rows, nth, mine, copy = unused(docs, "_key", "_times", "_rows", "_nth", "_mine", "_copy")
    tagged = docs.withColumn(key, row_key(F.xxhash64(text_or_empty())))
    plan = mix_sources(tagged.select("doc_id", "text", "source", key), keep=(key,), **options)
    plan = plan.groupBy(key).agg(F.sum(F.expr("if(size = 0, 0, taken div size)")).alias(times), F.count("*").alias(rows)).where(F.col(times) > 0)
    joined = tagged.join(plan, key).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    joined = joined.withColumn(mine, F.expr(f"{times} div {rows} + if({nth} <= {times} % {rows}, 1, 0)")).where(F.col(mine) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(mine).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
