"""The share of toxic documents that scores mean does not depend on the sample's size."""

from pyspark.sql import functions as F

from helixmill.llm import toxicity


def test_capped_classes_keep_their_shares(spark):
    docs = spark.range(1, 2001).select(F.col("id").alias("doc_id"), F.lit("the same words in every document").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    for max_docs in (20, 5000):
        scores = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels, max_docs=max_docs, trees=3)).select("score", "predicted").distinct().collect()
        assert len(scores) == 1 and abs(scores[0].score - 0.1) < 0.03 and scores[0].predicted == 0
