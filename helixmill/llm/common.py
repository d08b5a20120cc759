"""Helpers shared by the corpus operators: shared scratch tables, text normalisation, components."""

from __future__ import annotations

import string
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: ASCII white space, the class every contract here names.
WS = " \t\n\x0b\x0c\r"
EDGES_PER_TASK = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helixmill-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there and no executor owns it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df.scratch_path)


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(digest: Column) -> Column:
    """doc_id and a digest of the text as one string, never null, to join decisions back by."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), digest.cast("string"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def descending_batch(rows: DataFrame, n: int) -> Column:
    """Number of a row's batch, from 0 for the largest doc_ids to n - 1 for the smallest and for null; batches have about as many rows each.

    The borders are doc_ids found near the quantiles, so that neither the distance of ids nor their skew matters; equal ids share a batch.
    """
    borders = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], F.lit(1000))).first()[0] if n > 1 else None
    above = sum((F.col("doc_id") <= F.lit(b).cast("long")).cast("int") for b in borders) if borders else F.lit(0)
    return F.coalesce(above, F.lit(n - 1))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(src, dst) longs -> (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps; each round is one shuffle of the edges, written to the shared
    folder.  Self-loops and repeated edges are harmless; an empty table gives an empty result.
    Large nodes need no window or list: a star step is an aggregate followed by a join that may be split.
    The rounds needed grow with the logarithm of the nodes; RuntimeError where max_rounds don't suffice.
    """
    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    edges = materialize(edges, "cc")
    # edges only get fewer: as many tasks as they need now are enough for every round
    tasks = max(6, edges.count() // EDGES_PER_TASK + 1)
    keep = lambda df, name: materialize(df.coalesce(tasks), name)
    for _ in range(max_rounds):
        # large star: every neighbour above u points at the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (written, so that the join with a large node's edges stands alone and can be split)
        lowest = keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "cc-min")
        large = keep(both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        # small star: u and its smaller neighbours point at the smallest of these
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        step = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = keep(step.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        discard(edges, large, lowest, least)
        edges = small
        # done when every node has one parent and no parent has one
        ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        open_ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 OR up > 0 AND low = 0")
        if open_ends.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    out = keep(roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()), "cc-out")
    discard(edges)
    return out


#: Words of 64 bits in a KeyFilter: a broadcast of this many rows at most.
FILTER_WORDS = 1 << 17


def _slot(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key, F.lit(11))
    bit = F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")
    return F.pmod(h, F.lit(FILTER_WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def maybe_in(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """Adds a boolean: false only where df's key is surely not in keys, a table of one column.

    A bit set of fixed size is broadcast (FILTER_WORDS rows at most, whatever the number of keys): rows that fail it need
    no shuffle.  With more keys than it has bits it lets all through, which costs time and changes no result.
    """
    at, bits, mask = unused(df, "_filter_at", "_filter_bits", "_filter_mask")
    word, bit = _slot(F.col(f"`{keys.columns[0]}`"))
    table = materialize(keys.select(word.alias(at), bit.alias(bits)).groupBy(at).agg(F.bit_or(bits).alias(bits)), "filter")
    word, bit = _slot(F.col(f"`{key}`"))
    joined = df.withColumns({at: word, mask: bit}).join(F.broadcast(table), at, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) != 0, F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(flag))


def map_texts(rows: DataFrame, start, fields: str) -> DataFrame:
    """Adds columns computed from the column text, batch by batch; the others pass through unchanged.

    start() runs once per task and returns a function from a list of texts to a list of columns, as fields declares.
    """
    keep = [c for c in rows.columns if c != "text"]
    added = StructType.fromDDL(fields)
    schema = StructType([*[f for f in rows.schema if f.name != "text"], *added])
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches):
        make = start()
        for batch in batches:
            made = make(batch.column("text").to_pylist())
            arrays = [*[batch.column(c) for c in keep], *[pa.array(v, t) for v, t in zip(made, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
