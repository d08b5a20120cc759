"""Classification trees: lineage, closure, keyword search, leaves, folder paths.  nodes(node_id, parent_id, level, description)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.lineage import settle

MAX_DEPTH = 32


def closure(nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(ancestor, node_id, steps), each node being its own ancestor at 0 steps.  One join a level, until a level is empty.

    A tree of more than depth levels, or a cycle, is a ValueError: no ancestor is lost silently.
    """
    step = nodes.where("parent_id IS NOT NULL").select(F.col("node_id").alias("child"), "parent_id")
    now = nodes.select(F.col("node_id").alias("ancestor"), "node_id", F.lit(0).alias("steps"))
    levels = [now]
    for k in range(1, depth + 1):
        now = settle(now.join(step, F.col("ancestor") == F.col("child")).select(F.col("parent_id").alias("ancestor"), "node_id", F.lit(k).alias("steps")))
        if now.isEmpty():
            break
        if k == depth:
            raise ValueError(f"the tree has more than {depth} levels")
        levels.append(now)
    return reduce(DataFrame.unionByName, levels)


def lineage(nodes: DataFrame, separator: str = " > ", depth: int = MAX_DEPTH) -> DataFrame:
    """(node_id, lineage): "level: description" from the root down."""
    up = closure(nodes, depth).join(nodes.select(F.col("node_id").alias("ancestor"), F.concat_ws(": ", F.col("level").cast("string"), "description").alias("text")), "ancestor")
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("k"), "text"))), lambda p: p["text"])
    return up.groupBy("node_id").agg(F.array_join(parts, separator).alias("lineage"))


def find_domains(domains: DataFrame, column: str, prefix: str, first_only: bool = False) -> DataFrame:
    found = domains.where(F.col(column).startswith(prefix))
    if first_only:
        found = found.withColumn("_k", F.row_number().over(Window.partitionBy(column).orderBy("node_id"))).where("_k = 1").drop("_k")
    return found


def same_levels(domains: DataFrame, key: str) -> DataFrame:
    """Whether all domains of a set share class, fold, superfamily and family (sccs split at its dots)."""
    cut = lambda k: F.array_join(F.slice(F.split("sccs", r"\."), 1, k), ".")
    names = ("same_class", "same_fold", "same_superfamily", "same_family")
    return domains.groupBy(key).agg(*[(F.count_distinct(cut(k + 1)) == 1).alias(n) for k, n in enumerate(names)])


def keyword_hits(nodes: DataFrame, include: list[str], exclude: list[str] = (), levels: list[int] | None = None, comments: DataFrame | None = None, below_hits: bool = False) -> DataFrame:
    """Nodes whose description or comment matches every include and no exclude pattern (any case); those under a hit only on request."""
    d = nodes
    text = [F.col("description")]
    if comments is not None:
        d = d.join(comments.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("comment")), "\n").alias("comment")), "node_id", "left")
        text.append(F.col("comment"))
    any_of = lambda p: reduce(Column.__or__, [F.coalesce(t.rlike("(?i)" + p), F.lit(False)) for t in text])
    d = d.where(reduce(Column.__and__, [any_of(p) for p in include] + [~any_of(p) for p in exclude]))
    if levels is not None:
        d = d.where(F.col("level").isin(*levels))
    hits = d.select("node_id", "level", "description")
    if below_hits:
        return hits
    above = closure(nodes).where("steps > 0").join(hits.select(F.col("node_id").alias("ancestor")), "ancestor", "left_semi").select("node_id").distinct()
    return hits.join(above, "node_id", "left_anti")


def leaves_under(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """(hit, node_id) of the childless nodes at or under each hit."""
    down = closure(nodes).join(hits.select(F.col("node_id").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("ancestor").alias("hit"), "node_id")
    parents = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id")).distinct()
    return down.join(parents, "node_id", "left_anti").dropDuplicates(["hit", "node_id"])


def folder_name(description: Column, node_id: Column) -> Column:
    """The description without characters that file names may not have; over 20 characters cut and numbered."""
    clean = F.translate(description, '\\/:*?"<>|', "")
    return F.when(F.length(clean) > 20, F.concat(F.substring(clean, 1, 20), F.lit("_"), node_id.cast("string"))).otherwise(clean)


def folder_paths(nodes: DataFrame, separator: str = "/") -> DataFrame:
    named = nodes.withColumn("description", folder_name(F.col("description"), F.col("node_id")))
    up = closure(named).join(named.select(F.col("node_id").alias("ancestor"), "description"), "ancestor")
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("k"), "description"))), lambda p: p["description"])
    return up.groupBy("node_id").agg(F.array_join(parts, separator).alias("path"))


def file_location(sid: Column) -> Column:
    """Domain files lie in folders named by the sid's third and fourth characters."""
    return F.concat(F.substring(sid, 3, 2), F.lit("/"), sid, F.lit(".ent"))


def without_files(domains: DataFrame, catalogue: DataFrame) -> DataFrame:
    return domains.join(catalogue.select("structure_id"), domains["pdbid"] == F.col("structure_id"), "left_anti")


def subtree_profile(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """(root, role, node_id, parent_id, level, description): ancestors of each hit, the hit and all below it."""
    h = hits.select(F.col("node_id").alias("root")).distinct()
    c = closure(nodes)
    up = c.where("steps > 0").join(h, F.col("node_id") == F.col("root")).select("root", F.lit("lineage").alias("role"), F.col("ancestor").alias("node_id"))
    down = c.join(h, F.col("ancestor") == F.col("root")).select("root", F.lit("member").alias("role"), "node_id")
    return up.unionByName(down).join(nodes, "node_id").select("root", "role", "node_id", "parent_id", "level", "description")
