"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression (operator 9).

Features of a whole text: densities of learned toxic words and word beginnings, their number near second-person words,
capitals, punctuation, digits, repeated characters and obfuscated spellings.  The lexicon is learned from labelled rows.
Trees and calibration are fitted by Spark ML on bounded samples (``max_docs`` documents a class); the rows of remainder
1 by 5 calibrate, 2 to 4 train, 0 are held out.  Sampled rows weigh as many labelled rows of their class as they stand for,
so a score means the same at any size.  Scoring reads every whole text.

Defined results: a null text counts as empty and has zero features; a null doc_id is never held out; without labels of both
classes every score is the share of label 1 (0 without labels); conflicting labels of one doc_id count as the
larger; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_or_empty
from .quality import labelled, remainder

WORD = re.compile(r"[^\W\d_]+")
#: Spellings that hide a word: letters with digits or signs between them, or single letters set apart.
#: A spelling starts where a run of letters does, so that a long run is looked at once.
HIDDEN = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$*!|]++[^\W\d_]++|\b(?:[^\W\d_][.\-_* ]){3,}[^\W\d_]\b")
REPEATED = re.compile(r"(.)\1{3,}")
LEET = str.maketrans("013457@$!|", "oieastasii")

#: Second-person words (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())

FEATURES = ("word_density", "word_any", "stem_density", "stem_any", "near_second_person", "second_person", "hidden_density", "hidden_lexicon", "capitals", "capital_words", "exclamations", "punctuation", "digits", "repeats", "log_words")
STEM = range(4, 9)


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]


def learn_lexicon(sample: DataFrame, max_terms: int = 400, min_docs: int = 3, min_odds: float = 2.5) -> Lexicon:
    """Words, and word beginnings of 4 to 8 letters, that toxic documents hold far more often: document counts by Spark."""

    def terms(batches):
        for pdf in batches:
            count = Counter()
            for y, t in zip(pdf.label, pdf.text):
                ws = set(WORD.findall(t.lower()))
                count.update(("w" + w, y) for w in ws)
                count.update(("s" + s, y) for s in {w[:k] for w in ws for k in STEM if len(w) >= k})
            yield pd.DataFrame([(k, y, n) for (k, y), n in count.items()], columns=["term", "label", "n"])

    n = dict(sample.groupBy("label").count().collect())
    good, bad = n.get(0, 0), n.get(1, 0)
    counts = sample.select("label", "text").mapInPandas(terms, "term string, label int, n long").groupBy("term").agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("bad"), F.sum(F.expr("if(label = 0, n, 0)")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    found = counts.where((F.col("bad") >= min_docs) & (odds >= min_odds)).orderBy((odds * F.sqrt("bad")).desc(), "term")
    rows = [r.term for r in found.limit(max_terms).collect()]
    return Lexicon(frozenset(r[1:] for r in rows if r[0] == "w"), frozenset(r[1:] for r in rows if r[0] == "s"))


HIT, STEMMED, YOU, CAPITAL = 1, 2, 4, 8
PUNCTUATION = ".,;:?!'\"-()*#$%&@"


class WordMarks(dict):
    """What the lexicon says of a word, as bits; each word of a task is looked up once."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        w, lexicon = word.lower(), self.lexicon
        mark = HIT * (w in lexicon.words) | STEMMED * any(w[:k] in lexicon.stems for k in STEM) | YOU * (w in SECOND_PERSON) | CAPITAL * (len(w) > 1 and word.isupper())
        self[word] = mark
        return mark


def dense_features(text: str, lexicon: Lexicon, known: WordMarks | None = None) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    known = known if known is not None else WordMarks(lexicon)
    marks = np.array([known[w] for w in WORD.findall(text)], np.uint8)
    n = max(len(marks), 1)
    hits, yous = np.flatnonzero(marks & HIT), np.flatnonzero(marks & YOU)
    stems, near = int(np.count_nonzero(marks & STEMMED)), 0
    if len(hits) and len(yous):
        at = np.searchsorted(yous, hits)
        after, before = yous[np.minimum(at, len(yous) - 1)], yous[np.maximum(at - 1, 0)]
        near = int((np.minimum(abs(after - hits), abs(before - hits)) <= 5).sum())
    hidden = HIDDEN.findall(text)
    told = sum(re.sub(r"[^a-z]", "", h.lower().translate(LEET)) in lexicon.words for h in hidden)
    c, count = len(text), Counter(text)
    return [
        1000 * len(hits) / n, float(len(hits)), 1000 * stems / n, float(stems), 1000 * near / n, 1000 * len(yous) / n, 1000 * len(hidden) / n, float(told),
        sum(k for x, k in count.items() if x.isupper()) / c, int(np.count_nonzero(marks & CAPITAL)) / n, count["!"] / c, sum(count[x] for x in PUNCTUATION) / c,
        sum(k for x, k in count.items() if x.isdigit()) / c, 1000 * len(REPEATED.findall(text)) / c, math.log1p(len(marks)),
    ]


def with_features(docs: DataFrame, lexicon: Lexicon, *more: str) -> DataFrame:
    """The columns named, and features array<double>."""
    rows = docs.select(*more, text_or_empty().alias("text"))

    def start():
        known = WordMarks(lexicon)
        return lambda texts: [[dense_features(t, lexicon, known) for t in texts]]

    return map_texts(rows, start, "features array<double>")


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    curve: object | None
    share: float


def class_weights(labels: DataFrame, keep, max_docs: int) -> dict[int, float]:
    """Labelled rows of a class for each one that a sample of at most max_docs has."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & keep).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return {y: n / min(n, max_docs) for y, n in known.groupBy("label").count().collect()}


def train_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 2000, trees: int = 20, depth: int = 3, seed: int = 7) -> ToxicityModel:
    part = remainder(5)
    sample = labelled(docs, labels, "toxic", part >= 2, max_docs, seed)
    n = dict(sample.groupBy("label").count().collect())
    if not n.get(0) or not n.get(1):
        return ToxicityModel(Lexicon(frozenset(), frozenset()), None, None, float(bool(n.get(1))))
    lexicon = learn_lexicon(sample)
    rows = with_features(sample, lexicon, "doc_id", "label").toPandas().sort_values("doc_id")  # 2 * max_docs rows at most
    rows["w"] = rows.label.map(class_weights(labels, part >= 2, max_docs))
    frame = docs.sparkSession.createDataFrame(rows[["label", "features", "w"]], "label int, features array<double>, w double").select(F.col("label").cast("double"), array_to_vector("features").alias("features"), "w").coalesce(1)
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3, weightCol="w").fit(frame)
    other = labelled(docs, labels, "toxic", part == 1, max_docs, seed + 1)
    scored = _raw(with_features(other, lexicon, "doc_id", "label"), fitted).select(F.col("label").cast("double").alias("label"), "raw").toPandas()
    curve = None
    if scored.label.nunique() == 2:
        scored["w"] = scored.label.map(class_weights(labels, part == 1, max_docs))
        frame = docs.sparkSession.createDataFrame(scored).coalesce(1)
        curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="w").fit(frame)
    return ToxicityModel(lexicon, fitted, curve, 0.0)


def _raw(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    keep = [c for c in rows.columns if c != "features"]
    out = trees.transform(rows.withColumn("features", array_to_vector("features")))
    return out.select(*keep, vector_to_array("probability")[1].alias("raw"))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "text")
    if model.trees is None:
        out = rows.select("doc_id", "held_out", F.lit(model.share).alias("score"))
    else:
        out = _raw(with_features(rows, model.lexicon, "doc_id", "held_out"), model.trees)
        out = model.curve.transform(out).withColumnRenamed("prediction", "score") if model.curve is not None else out.withColumnRenamed("raw", "score")
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", F.expr("cast(score >= 0.5 as int)"))
