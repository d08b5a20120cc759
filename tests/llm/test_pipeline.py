"""The quality score of a fixed model without Spark; the pipeline as a whole, and its stages on odd rows."""

import hashlib
import math
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from helixmill.llm import common, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (None, "Same text here", "en", None, 3), (4, "same TEXT here", "en", "b", 3), (4, "same TEXT here", "en", "b", 3), (5, "Ünïcode É text\nline\n\n", None, "b", 2), (6, " \t\n", "x", "", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("digest", "row", "key", "_key", "_nth", "_doubt", "_copy", "size", "kept", "label", "score", "pattern", "bin", "node", "words")})


def score(model, text):
    """The curve over sizes that zstandard gives with either dictionary, piece by piece."""
    data = (text or "").encode()
    parts = [data[i : i + quality.PIECE] for i in range(0, len(data), quality.PIECE)]
    size = lambda d, p: len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(p))
    sizes = [(size(model.good, p), size(model.bad, p), len(p)) for p in parts]
    z = model.weights[0]
    if sizes:
        g, b, n = (sum(c) for c in zip(*sizes))
        least = min([0.0, *[math.log(min(x, y) / m) for x, y, m in sizes if m >= quality.LEAST]])
        z += sum(w * v for w, v in zip(model.weights[1:], (10 * (b - g) / (b + g), (b - g) / math.sqrt(b + g), math.log(min(g, b) / n), least)))
    return 1 / (1 + math.exp(-z))


def test_quality_scores_are_the_models(spark, odd):
    good, bad = b"plain sentences of ordinary prose about places and people. " * 40, b"click here buy now win!!! $$$ " * 80
    model = quality.QualityModel(good, bad, (0.3, 1.7, 0.4, 0.2, -0.1), 3)
    texts = ["ordinary prose about people", "win!!! click here $$$ buy now", "x" * 5000, "ab " * 700 + "ordinary prose about places", "", None]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_quality(df, model).collect()}
    assert quality.score_quality(odd, model).count() == 10
    for i, t in enumerate(texts):
        assert abs(got[i][0] - score(model, t)) < 1e-9 and got[i][1] == (got[i][0] >= 0.5)
    assert got[0][0] > 0.5 > got[1][0]


def test_stages_on_odd_rows(spark, odd):
    """Every stage but the last keeps the columns, none fails; what stays is a part of what came, or copies of it."""
    given = Counter((r.doc_id, r.text) for r in odd.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, odd, SF), "odd")
        assert out.columns == odd.columns, name
        left = Counter((r.doc_id, r.text) for r in out.collect())
        assert set(left) <= set(given) and (name == "mix" or all(left[k] <= given[k] for k in left)), name
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == 10
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.exact_dedup(spark, odd, SF).collect()}
    assert (4, "same TEXT here") in kept and (None, "Same text here") not in kept


def test_run_is_its_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), name)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(want) > 100
