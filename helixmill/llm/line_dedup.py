"""Line deduplication by levelled sorted runs of line hashes (operator 6).

Every document's lines are hashed once.  Batches of documents are reduced to a row per line hash (number of documents,
largest doc_id) and come from the largest doc_ids down.  A batch is merge-anti-joined with the runs: lines that no run
holds enter with the doc_id whose copy stays, known ones only add to their line's count.  Both become a run on level 0.  Before a batch enters, levels of ``fanout`` runs are compacted into one run of the next level.  Runs are tables
bucketed and sorted by hash, so joins with them and their compaction read them bucket by bucket.  Buckets follow the number of hashes, and no table is split by batch: where Spark
has no native Hadoop library, each file and folder that a task makes costs a process (chmod), so small ones are dear.

Defined results: a null or empty text is one empty line; a row with null doc_id counts as a document and its copy of a
common line goes unless all are null (then all copies stay); rows that repeat doc_id and text are one document, and get the same
result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, delete_path, descending_batch, discard, materialize, n_partitions, scratch, text_or_empty

RUN = "h1 long, h2 long, n_docs long, max_doc long, is_new boolean"
ROWS_PER_BUCKET = 100_000


class LineRuns:
    """Levels of sorted runs: (h1, h2, n_docs, max_doc, is_new); the sum over all runs is what has been seen."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or n_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, name)
        # as many tasks as buckets, also where the session deals out to more
        (df.repartition(self.buckets, "h1", "h2").coalesce(self.buckets).sortWithinPartitions("h1", "h2")
         .write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name, path=self.paths[name]))
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, batch: DataFrame, descending: bool = False) -> DataFrame:
        """batch(h1, h2, n_docs, max_doc), a row per hash.  Returns its run; is_new marks hashes that no run held before.

        Where batches come in descending order of doc_id only those bring a max_doc; known hashes add to counts alone.
        """
        self._compact()
        rest, old = batch.hint("merge"), []
        for run in self.runs():
            keys = run.select("h1", "h2")
            old.append(rest.join(keys, ["h1", "h2"], "left_semi").withColumns({"is_new": F.lit(False), "max_doc": F.lit(None).cast("long") if descending else F.col("max_doc")}))
            rest = rest.join(keys, ["h1", "h2"], "left_anti").hint("merge")
        rows = reduce(DataFrame.unionByName, [rest.withColumn("is_new", F.lit(True)), *old])
        self.levels[0].append(self._write(rows))
        return self.spark.table(self.levels[0][-1])

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) < self.fanout:
                continue
            merged = self._summed([self.spark.table(n) for n in self.levels[level]])
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            self._drop(level)

    def _drop(self, level: int) -> None:
        for name in self.levels[level]:
            self.spark.sql(f"DROP TABLE {name}")
            delete_path(self.spark, self.paths.pop(name))
        self.levels[level] = []

    def drop(self) -> None:
        for level in range(len(self.levels)):
            self._drop(level)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        """Merges sorted runs: a full outer sort-merge join adds up what both hold."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnsRenamed({"n_docs": "n2", "max_doc": "m2", "is_new": "i2"})
            both = a.hint("merge").join(b, ["h1", "h2"], "full_outer")
            return both.select("h1", "h2", F.expr("coalesce(n_docs, 0) + coalesce(n2, 0)").alias("n_docs"), F.greatest("max_doc", "m2").alias("max_doc"),
                               F.expr("coalesce(is_new, false) OR coalesce(i2, false)").alias("is_new"))

        return reduce(merge, runs)

    def totals(self) -> DataFrame:
        return self._summed(self.runs()) if self.runs() else self.spark.createDataFrame([], RUN)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line whose key has min_chars code points at least."""
    key = F.btrim(F.col("line"), F.lit(WS))
    lines = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"))
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("key", ascii_lower(key)).where(F.char_length("key") >= min_chars)
    return lines.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2nd"), "key").alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text.

    Of a line found in min_docs documents or more, only the copies in its largest doc_id stay.
    """
    spark = docs.sparkSession
    lines = materialize(line_hashes(docs, min_chars), "lines")
    batch = descending_batch(lines, n_batches).alias("batch")
    once = lines.select("h1", "h2", "doc_id", "text_hash").distinct()
    stats = once.groupBy(batch, "h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
    stats = materialize(stats.sortWithinPartitions("batch"), "line-stats")
    runs = LineRuns(spark, buckets=min(n_partitions(spark), stats.count() // ROWS_PER_BUCKET + 1))
    for b in range(n_batches):
        runs.add(stats.where(F.col("batch") == b).drop("batch"), descending=True)
    discard(stats)
    common = materialize(runs.totals().where(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc"), "common-lines")
    runs.drop()
    drops = lines.join(common, ["h1", "h2"]).where("NOT doc_id <=> max_doc").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))
    drops = drops.select(F.col("doc_id").alias("d_doc"), F.col("text_hash").alias("d_hash"), "drop")
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    joined = texts.join(drops, F.col("doc_id").eqNullSafe(F.col("d_doc")) & (F.col("text_hash") == F.col("d_hash")), "left")
    split = joined.select("doc_id", F.split("text", "\n").alias("lines"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    kept = F.array_join(F.filter("lines", lambda _, i: ~F.array_contains("drop", i)), "\n")
    return split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"),
                        F.when(F.size("drop") == 0, F.array_join("lines", "\n")).otherwise(kept).alias("kept_text"))

