"""Quality classifier by compression (operator 1).

Two zstandard dictionaries are built from labelled text, one of good and one of bad documents.  A text is cut into
pieces and each piece compressed with either; the normalised difference of the summed sizes is the evidence, which a
logistic curve fitted on other labelled documents turns into a probability; the curve also sees how far the text and its most
repetitive piece compress at all, as neither dictionary tells much about text that only repeats itself.  Pieces keep a dictionary's effect the same
all through a long text, and bound memory.

Dictionaries and curve are fitted on bounded samples (``max_docs`` documents a class and purpose, chosen by hash).
Scoring reads every whole text.  Defined results: a null text counts as empty; empty texts get the curve's value at no
difference; a null doc_id is never held out; without labels of both classes every score is the share of label 1 (0.5 without
labels); conflicting labels of one doc_id count as the larger; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, text_or_empty

PIECE = 1024
#: Pieces of fewer bytes say nothing about repetition.
LEAST = 200


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def build_dictionary(samples: list[bytes], size: int, level: int) -> bytes:
    """A trained dictionary; of the samples' own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Compressors:
    def __init__(self, model: QualityModel):
        self.pair = []
        for data in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(data) if data else None
            if d is not None:
                d.precompute_compress(level=model.level)
            self.pair.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_dict_id=False))

    def evidence(self, text: str | None) -> tuple[float, float, float, float]:
        """Difference per compressed byte, difference by the root of their number, log rate, least log rate of a piece."""
        good, bad = self.pair
        g = b = n = 0
        least = 0.0
        for p in pieces(text):
            x, y = len(good.compress(p)), len(bad.compress(p))
            g, b, n = g + x, b + y, n + len(p)
            if len(p) >= LEAST:
                least = min(least, math.log(min(x, y) / len(p)))
        return ((b - g) / (b + g), (b - g) / math.sqrt(b + g), math.log(min(g, b) / n), least) if n else (0.0,) * 4

    def features(self, texts: list[str | None]) -> np.ndarray:
        return _features(np.array([self.evidence(t) for t in texts], dtype=float).reshape(-1, 4))


def _features(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), 10 * evidence[:, 0], evidence[:, 1:]])


def fit_curve(evidence: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Weights of the logistic curve, by Newton steps with a small ridge."""
    x = _features(evidence)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (labels - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep, max_docs: int, seed: int) -> DataFrame:
    """At most max_docs labelled documents a class, the first by hash, of those that ``keep`` admits; of a repeated doc_id the least text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    ids = known.where("label = 1").orderBy(*order).limit(max_docs).unionByName(known.where("label = 0").orderBy(*order).limit(max_docs))
    ids = F.broadcast(materialize(ids, "label-sample"))  # 2 * max_docs rows at most
    return materialize(docs.select("doc_id", text_or_empty().alias("text")).join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")


def remainder(mod: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod


def train_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_pieces: int = 4000, dict_bytes: int = 1 << 16, level: int = 3, seed: int = 7) -> QualityModel:
    """Dictionaries from rows whose crc32 remainder by 3 is 0, the curve from those where it is 2.

    max_docs bounds the documents of a class in either sample, max_pieces the pieces a dictionary is built from.
    """
    sample = labelled(docs, labels, "quality", remainder(3) == 0, max_docs, seed)

    def cut(batches):
        for pdf in batches:
            rows = [(y, i, n, p) for i, y, t in zip(pdf.doc_id, pdf.label, pdf.text) for n, p in enumerate(pieces(t))]
            yield pd.DataFrame(rows, columns=["label", "doc_id", "n", "piece"])

    cuts = sample.mapInPandas(cut, "label int, doc_id long, n long, piece binary")
    chosen = {}
    for y in (0, 1):
        rows = cuts.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", "n", F.lit(seed)), "doc_id", "n").limit(max_pieces).collect()
        chosen[y] = [bytes(r.piece) for r in rows]
    if not chosen[0] or not chosen[1]:
        good, bad = len(chosen[1]), len(chosen[0])
        share = good / (good + bad) if good + bad else 0.5
        share = min(max(share, 0.01), 0.99)
        return QualityModel(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0), level)
    model = QualityModel(build_dictionary(chosen[1], dict_bytes, level), build_dictionary(chosen[0], dict_bytes, level), (0.0,) * 5, level)
    rest = labelled(docs, labels, "quality", remainder(3) == 2, max_docs, seed + 1)

    def start():
        c = Compressors(model)

        def weigh(texts):
            return list(zip(*[c.evidence(t) for t in texts])) or [[]] * 4

        return weigh

    fit = map_texts(rest.select("label", "text"), start, "per_byte double, per_root double, rate double, least double").toPandas()  # 2 * max_docs rows at most
    if fit.label.nunique() < 2:
        return QualityModel(model.good, model.bad, (0.0, 10.0, 1.0, 0.0, 0.0), level)
    # classes are sampled apart: shift the curve back to their shares among all labelled rows
    weights = fit_curve(fit[["per_byte", "per_root", "rate", "least"]].to_numpy(float), fit.label.to_numpy(float))
    known = labels.where(F.col("quality").isNotNull() & (remainder(3) == 2)).agg(F.sum(F.col("quality").cast("long")), F.count("*")).first()
    odds, had = np.log(known[0] / max(known[1] - known[0], 1)), np.log(fit.label.sum() / max((1 - fit.label).sum(), 1))
    return QualityModel(model.good, model.bad, (weights[0] + float(odds - had), *weights[1:]), level)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def start():
        c, w = Compressors(model), np.array(model.weights)

        def score(texts):
            p = 1 / (1 + np.exp(-np.clip(c.features(texts) @ w, -30, 30)))
            return [p, (p >= 0.5).astype("int32")]

        return score

    rows = docs.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return map_texts(rows, start, "score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents whose score is 0.5 or more, with all their columns."""

    def keep(batches):
        c, w = Compressors(model), np.array(model.weights)
        for batch in batches:
            yield batch.filter(pa.array(c.features(batch.column("text").to_pylist()) @ w >= 0, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
