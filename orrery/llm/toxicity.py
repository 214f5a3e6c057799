"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .shared import arrow_map
from .textkit import MARKS, by_bytes, hash_words, mix

BITS = 20
#: Bounds of the labelled training sample, per class, and characters of a sampled document.
POSITIVE, NEGATIVE, MOST_CHARS = 2500, 5000, 50_000
THRESHOLD = 0.7
_U = np.uint64


def feature_ids(words: np.ndarray) -> np.ndarray:
    """Indexes of a text's words, word pairs, and pairs that skip one or two words."""
    shift = _U(64 - BITS)
    out = [mix(words + _U(1)) >> shift]
    for gap, salt in ((1, 2), (2, 3), (3, 4)):
        if len(words) > gap:
            out.append(mix(words[:-gap] * _U(0x9E3779B97F4A7C15) + (words[gap:] ^ _U(salt))) >> shift)
    return np.concatenate(out).astype(np.int32)


def text_features(texts: list[str | None]):
    """For each text, the sorted distinct feature indexes of the whole text."""
    for _, blobs in by_bytes(texts):
        words, bounds = hash_words(blobs, MARKS)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(feature_ids(words[a:b]))


class Ftrl:
    """Per-coordinate rates; L1 keeps a weight at zero until its gradients agree."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z = self.z[idx]
        keep = np.where(idx == 1 << BITS, 0.0, self.l1)  # the bias has no L1
        return np.where(np.abs(z) <= keep, 0.0, -(z - np.sign(z) * keep) / ((self.beta + np.sqrt(self.n[idx])) / self.alpha + self.l2))

    def update(self, idx: np.ndarray, label: float) -> None:
        idx = np.append(idx, 1 << BITS)
        w = self.weights(idx)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / self.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] += g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(indexes, weights, bias): the non-zero weights only."""
        w = self.weights(np.arange((1 << BITS) + 1))
        idx = np.flatnonzero(w[:-1])
        return idx.astype(np.int32), w[idx].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, epochs: int = 5, seed: int = 11):
    """Fit on a bounded sample of labelled rows: the first POSITIVE and NEGATIVE by hash of doc_id.

    A doc_id labelled twice counts as toxic if any label says so; null labels and documents over
    MOST_CHARS characters are left out; of texts that share a doc_id the first is learned from. Without
    labels or documents the model is empty and scores 0.5. Other columns play no part.
    """
    model = Ftrl()
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).withColumn("__h", F.xxhash64("doc_id", F.lit(seed)))
    picked = None
    for label, most in ((1, POSITIVE), (0, NEGATIVE)):
        part = own.where(F.col("__toxic") == label).orderBy("__h", "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["__toxic"], r["__h"]) for r in picked.collect()], "doc_id long, __toxic int, __h long")
    found = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS).join(F.broadcast(ids), "doc_id")  # at most POSITIVE + NEGATIVE rows
    found = found.groupBy("doc_id", "__toxic", "__h").agg(F.min("text").alias("text"))  # a doc_id counts once
    rows = sorted((r["__h"], r["text"] or "", r["__toxic"]) for r in found.collect())
    data = list(zip(text_features([t for _, t, _ in rows]), [y for _, _, y in rows], strict=True))
    del rows
    for _ in range(epochs):
        for idx, y in data:
            model.update(idx, y)
    return model.compact()


def score_documents(docs: DataFrame, weights) -> DataFrame:
    """(doc_id, score) of every whole text; a null or empty text scores the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    dense: list[np.ndarray] = []

    def rows(part):
        idx, w, bias = shared.value
        if not dense:
            dense.append(np.zeros(1 << BITS, np.float32))
            dense[0][idx] = w
        margins = np.array([float(dense[0][f].sum()) + bias for f in text_features(part["text"].to_pylist())])
        return {"doc_id": part["doc_id"], "score": 1 / (1 + np.exp(-np.clip(margins, -35, 35)))}

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, score double")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(1, 3))
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
