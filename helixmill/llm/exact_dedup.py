"""Exact deduplication against a persistent digest index (operator 2; DataFrame operations only).

The index is a table bucketed and sorted by digest.  A batch is reduced to one row per digest, the digests that
the index already holds are removed by a sort-merge anti-join (the index side is read bucket by bucket, unshuffled)
and the rest are appended with the number of their run.  The rows that stay are those first appended; of a later run's texts that an
earlier run indexed, none stays.

Defined results: a null text counts as empty; a null doc_id ranks below every other; of rows that repeat both text and
doc_id one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, delete_path, descending_batch, materialize, n_partitions, row_key, scratch, text_or_empty, unused


def text_digest(col: str = "text") -> Column:
    """SHA-256 (hex) of the text with A-Z lower-cased."""
    return F.sha2(ascii_lower(text_or_empty(col)).cast("binary"), 256)


class DigestIndex:
    """Digests of all texts kept so far: (digest, doc_id, row, run), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch(spark, self.name)
        self.buckets = buckets or n_partitions(spark)
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest STRING, doc_id BIGINT, row BIGINT, run STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame, run: str = "") -> None:
        """batch(digest, doc_id, row) of a run: of each digest not yet indexed, the row of the largest doc_id is appended."""
        best = F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("r")))
        fresh = batch.groupBy("digest").agg(best.alias("b")).select("digest", "b.doc_id", (-F.col("b.r")).alias("row"), F.lit(run).alias("run"))
        fresh = fresh.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        (fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name, path=self.path))
        self.spark.catalog.refreshTable(self.name)

    def winners(self) -> DataFrame:
        """The index as plain files, for joins whose other side may be skewed (Spark then splits large partitions)."""
        return self.spark.read.schema("digest string, doc_id long, row long, run string").parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete_path(self.spark, self.path)


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, n_batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The digests are written once; batches enter the index from the largest doc_ids down, so that the first row of a
    digest to be indexed is that of its largest doc_id.  With an index of earlier runs, keep_id may be a document of theirs.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    own = index is None
    index = DigestIndex(spark) if own else index
    rows = materialize(docs.select("doc_id", text_digest().alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    number = descending_batch(rows, n_batches)
    for b in range(n_batches):
        index.add(rows.where(number == b), run)
    counts = materialize(rows.groupBy("digest").agg(F.count("*").alias("group_size")).join(index.winners().withColumnsRenamed({"doc_id": "keep_id", "row": "keep_row", "run": "keep_run"}), "digest"), "digest-groups")
    if own:
        index.drop()
    return rows.join(counts, "digest").select(
        "doc_id", "keep_id", "group_size", ((F.col("row") == F.col("keep_row")) & (F.col("keep_run") == run)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; the text is shuffled once, by doc_id and digest."""
    key, nth = unused(docs, "_key", "_nth")
    kept = exact_duplicates(docs).where("kept").select(row_key(F.col("text_sha256")).alias(key)).distinct()
    joined = docs.withColumn(key, row_key(text_digest())).join(kept, key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key).orderBy(key))  # rows that repeat doc_id and text
    return joined.withColumn(nth, first).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
