"""The corpus operators as queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe import encode_documents
from .exact_dedup import exact_duplicates
from .lexical_search import ranked_search
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .mpeg import documents_as_media
from .ngram_join import near_duplicates
from .quality import score_quality, train_quality
from .runs import run_digests, with_periods, word_runs
from .secret_scan import scan_secrets, span_digests
from .toxicity import score_toxicity, train_toxicity
from .warc import pages_through_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return score_quality(docs, train_quality(docs, labels))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("blocks")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_through_archives(_table(spark, sf_dir, "pages"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("sources")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_media(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return score_toxicity(docs, train_toxicity(docs, labels))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # only the documents to be made periodic are split here
    planted = docs.select("doc_id", "text", F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, words).alias("words"))
    return run_digests(word_runs(planted, F.coalesce(with_periods(F.col("words"), F.col("doc_id")), F.col("text"))))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(scan_secrets(_table(spark, sf_dir, "documents")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_exact_dedup, op3_license_scan, op4_warc, op5_mix, op6_line_dedup, op7_ngram_join, op8_mpeg, op9_toxicity, op10_bpe, op11_periodic_runs, op12_secret_scan, op13_ranked_search)
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op3_license_scan": oracles.license_scan(),
    "op4_warc": oracles.ARCHIVES,
    "op5_mix": oracles.mixing(),
    "op6_line_dedup": oracles.LINE_DEDUP,
    "op7_ngram_join": oracles.ngram_join(),
    "op12_secret_scan": oracles.secret_scan(),
    "op13_ranked_search": oracles.lexical_search(),
}
