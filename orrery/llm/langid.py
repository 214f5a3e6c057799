"""Language identification: the family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map
from .textkit import LOWER

#: Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "uralic": "fi et hu".split(),
}
DIMS = 1 << 13
#: Bounds of the training sample: documents of each language, of all languages together (the share of
#: each shrinks, none is left out), and characters of a sampled document.
PER_LANG, MOST_DOCS, MOST_CHARS = 400, 8_000, 50_000


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def features(text: str) -> np.ndarray:
    """Hashed counts of byte pairs and triples of the whole lower-cased text, scaled to length 1."""
    b = LOWER[np.frombuffer(text.lower().encode(), np.uint8)].astype(np.uint32)
    x = np.zeros(DIMS, np.float32)
    if len(b) >= 2:
        pair = b[:-1] << np.uint32(8) | b[1:]
        x += np.bincount((pair * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMS)
        if len(b) >= 3:
            x += np.bincount(((pair[:-1] << np.uint32(8) | b[2:]) * np.uint32(2246822519)) >> np.uint32(19), minlength=DIMS)
    x = np.sqrt(x)
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights (with a bias last) of a linear SVM with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    q = (x * x).sum(1) + 1 / (2 * c)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * c)
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Voter:
    """One-versus-one machines over a few classes; the class with the most wins, then the largest margin."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.names = sorted(set(labels))
        own = np.array([self.names.index(v) for v in labels])
        self.pairs = list(combinations(range(len(self.names)), 2))
        ws = []
        for a, b in self.pairs:
            pick = (own == a) | (own == b)
            ws.append(fit_svm(x[pick], np.where(own[pick] == a, 1.0, -1.0)))
        self.w = np.array(ws).reshape(len(self.pairs), x.shape[1] + 1)

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, smallest winning margin) of each row; one class wins with certainty."""
        if not self.pairs:
            return np.zeros(len(x), int), np.full(len(x), np.inf)
        m = x @ self.w[:, :-1].T + self.w[:, -1]
        votes, total = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += m[:, k] > 0
            votes[:, b] += m[:, k] <= 0
            total[:, a] += m[:, k]
            total[:, b] -= m[:, k]
        best = (votes + total / (1e3 + np.abs(total).max())).argmax(1)
        least = np.full(len(x), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            least = np.where(best == a, np.minimum(least, m[:, k]), np.where(best == b, np.minimum(least, -m[:, k]), least))
        return best, least


class Model:
    """``predict(texts)`` -> (language, score); learned from (text, language) rows."""

    def __init__(self, rows: list[tuple[str, str]]):
        x = np.array([features(t) for t, _ in rows], np.float32).reshape(len(rows), DIMS)
        families = [family(v) for _, v in rows]
        self.families = Voter(x, families)
        self.within = {}
        for f in self.families.names:
            pick = [i for i, v in enumerate(families) if v == f]
            self.within[f] = Voter(x[pick], [rows[i][1] for i in pick])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``und`` with score 0 if the text is null or has no letter, or if nothing was learned."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not live or not self.families.names:
            return out
        x = np.array([features(texts[i]) for i in live], np.float32)
        fam, fam_margin = self.families.choose(x)
        for f, name in enumerate(self.families.names):
            pick = np.flatnonzero(fam == f)
            if len(pick):
                lang, margin = self.within[name].choose(x[pick])
                sure = lambda v: 1 / (1 + np.exp(-4 * np.clip(v, -50, 50)))
                score = sure(fam_margin[pick]) * sure(margin)
                for i, v, s in zip(pick, lang, score, strict=True):
                    out[live[i]] = (self.within[name].names[v], float(s))
        return out


def train(docs: DataFrame, seed: int = 7) -> Model:
    """Learn from a bounded sample: the first documents of each language by hash of doc_id.

    PER_LANG of them, fewer if there are over MOST_DOCS / PER_LANG languages. A first cut by the hash, at
    twice the share that a language's count asks for, keeps the ranking small. Rows with a null text or
    lang, without letters or over MOST_CHARS characters are not learned from. Ties go by doc_id and
    text, repeated rows count as often as they occur; an empty table gives a model that says ``und``.
    """
    usable = docs.where("lang is not null and text is not null").where(F.length("text") <= MOST_CHARS).withColumn("__u", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)))
    counts = sorted((r[0], r[1]) for r in docs.where("lang is not null and text is not null").where(F.length("text") <= MOST_CHARS).groupBy("lang").count().collect())
    if not counts:
        return Model([])
    each = max(1, min(PER_LANG, MOST_DOCS // len(counts)))
    share = F.create_map(*(v for lang, n in counts for v in (F.lit(lang), F.lit(int((1 << 20) * min(1.0, (2 * each + 50) / n)) + 1))))
    picked = usable.where(F.col("__u") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0))).select("text", "lang", "__u", "doc_id")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("__u", "doc_id", "text"))
    rows = picked.withColumn("__nth", nth).where(F.col("__nth") <= each).collect()
    return Model([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["__u"], r["doc_id"] or 0, r["text"])) if any(map(str.isalpha, r["text"]))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``; the model is broadcast (pairs of languages in a family times DIMS).

    Null texts and those without letters are ``und`` with score 0; texts of any length are read whole,
    rows that are repeated get equal answers, an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(part):
        got = shared.value.predict(part["text"].to_pylist())
        return {"doc_id": part["doc_id"], "lang_pred": [v for v, _ in got], "score": [s for _, s in got]}

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, lang_pred string, score double", 128)


def held_out(fold: int, folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(0, 5) & F.col("doc_id").isNotNull()))
    return identify(docs, model).select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", "score")
