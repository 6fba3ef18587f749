"""Toxicity by cumulative-link ordinal regression over words and word beginnings (operator 1)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermal_lake.llm.common import map_arrow, written

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that are learnt from at most, by the hash of their id: the documented bound of the learning sample.
SAMPLE = 20_000
#: The association (in standard errors) and the number of texts that a feature needs for a weight; all that have them get one.
LEAST_Z, LEAST_TEXTS = 5.0, 4
GRADES = 4
#: Distinct words that a counting task holds before it hands on what it has.
HELD = 300_000
#: The probability of grade 1 or more from which a text is called toxic.
TOXIC = 0.6
#: Lengths of the word beginnings that are features too, so that an unseen form of a known word counts.
STEMS = (5, 7)


def features(text: str | None) -> set[str]:
    """A text's distinct words, and the beginnings (after ^) of the longer ones."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union(*({f"^{w[:n]}" for w in words if len(w) > n} for n in STEMS))


@dataclass
class Model:
    """P(grade >= k) = 1 / (1 + exp(thresholds[k - 1] - the sum of the weights of a text's words)); thresholds ascend, all share the weights."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.weights
        total = sum([w[x] for x in features(text) & w.keys()])
        return 1 / (1 + np.exp(np.clip(self.thresholds - total, -500, 500)))


@dataclass
class Sparse:
    """A 0/1 matrix by the rows and columns of its ones."""

    rows: np.ndarray
    columns: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, x: np.ndarray | Sparse) -> Sparse:
        return x if isinstance(x, cls) else cls(*np.nonzero(x), x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns], minlength=self.shape[0]).astype(float)

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=v[self.rows], minlength=self.shape[1]).astype(float)


def conjugate_gradient(apply, b: np.ndarray, diagonal: np.ndarray, steps: int = 1000) -> np.ndarray:
    """x with apply(x) = b, apply being symmetric and positive; the diagonal preconditions."""
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    p, rz = z, r @ z
    for _ in range(steps):
        if np.abs(r).max() <= 1e-12 * max(1.0, np.abs(b).max()):
            break
        q = apply(p)
        size = rz / (p @ q)
        x, r = x + size * p, r - size * q
        z = r / diagonal
        rz, old = r @ z, rz
        p = z + rz / old * p
    return x


def fit_ordinal(x: np.ndarray | Sparse, y: np.ndarray, n: np.ndarray, grades: int, penalty: float = 0.1, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the penalised likelihood of grades y, each row counted n times, by Fisher scoring with halved steps; x is sparse, so any number of features fits."""
    x = Sparse.of(x)
    d, at = x.shape[1], np.arange(len(y))
    share = np.clip([n[y >= k].sum() / n.sum() for k in range(1, grades)], 1e-4, 1 - 1e-4)
    w, theta = np.zeros(d), -np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1)

    def above(w: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return np.concatenate((np.ones((len(y), 1)), 1 / (1 + np.exp(np.clip(theta - x.times(w)[:, None], -40, 40))), np.zeros((len(y), 1))), 1)

    def likelihood(w: np.ndarray, theta: np.ndarray) -> float:
        if (np.diff(theta) <= 0).any():
            return -np.inf
        g = above(w, theta)
        return float(n @ np.log(np.maximum(g[at, y] - g[at, y + 1], 1e-300)) - penalty * w @ w / 2)

    best = likelihood(w, theta)
    for _ in range(steps):
        g = above(w, theta)
        s = g * (1 - g)
        p = np.maximum(g[:, :-1] - g[:, 1:], 1e-12)
        # by[i, k] is the slope of P(grade k) in the score (first) and in each threshold
        by = np.zeros((len(y), grades, grades))
        by[:, :, 0] = s[:, :-1] - s[:, 1:]
        for k in range(1, grades):
            by[:, k, k] = -s[:, k]
            by[:, k - 1, k] = s[:, k]
        slope = by[at, y] / p[at, y][:, None] * n[:, None]
        info = np.einsum("nki,nkj,nk->nij", by, by, n[:, None] / p)
        outer = info[:, 1:, 1:].sum(0) + 1e-9 * np.eye(grades - 1)

        def curvature(v: np.ndarray, info=info, outer=outer) -> np.ndarray:
            mid = info[:, 0, 0] * x.times(v[:d]) + info[:, 0, 1:] @ v[d:]
            return np.concatenate((x.transposed(mid) + penalty * v[:d], info[:, 1:, 0].T @ x.times(v[:d]) + outer @ v[d:]))

        gradient = np.concatenate((x.transposed(slope[:, 0]) - penalty * w, slope[:, 1:].sum(0)))
        step = conjugate_gradient(curvature, gradient, np.concatenate((x.transposed(info[:, 0, 0]) + penalty, np.diag(outer))))
        size = 1.0
        while size > 1e-6 and (now := likelihood(w + size * step[:d], theta + size * step[d:])) < best:
            size /= 2
        if size <= 1e-6:
            break
        w, theta, gain, best = w + size * step[:d], theta + size * step[d:], now - best, now
        if gain < 1e-10 * abs(best):
            break
    return w, theta


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, toxic, clean): how many distinct texts of either kind have a feature, added up within tasks first."""

    def kernel(batches) -> Iterator[dict]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> dict:
            words = list(held[0].keys() | held[1].keys())
            out = {"word": words, "toxic": [held[1][w] for w in words], "clean": [held[0][w] for w in words]}
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[label > 0].update(features(text))
            if len(held[0]) + len(held[1]) > HELD:
                yield flush()
        yield flush()

    return map_arrow(texts.select("text", "label"), "word string, toxic long, clean long", kernel).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def associated(counts: DataFrame, toxic: int, clean: int) -> list[tuple[str, float]]:
    """The features associated with toxic texts, or with clean ones, beyond chance, and by how much: no more than the sample has."""
    share = F.lit(1.0) * (F.col("toxic") + F.col("clean")) / (toxic + clean)
    z = (F.col("toxic") / max(1, toxic) - F.col("clean") / max(1, clean)) / F.sqrt(share * (1 - share) * (1 / max(1, toxic) + 1 / max(1, clean)) + 1e-12)
    found = counts.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).withColumn("z", z).where(F.abs("z") >= LEAST_Z)
    return [(r["word"], r["z"]) for r in found.orderBy("word").collect()]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grades: int = GRADES, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows (those whose ids hash least), of the labels whose id and value aren't null.

    Labels above 1 are grades as they are. Labels of 0 and 1 alone say no grade: a row with 1 then gets 1, 2, ... by how many of the features
    associated with it the text has (quantiles of that number among such rows): with such labels the severity beyond 1 says how much toxic vocabulary a text has, as no
    label says more. Equal texts count once. Words are counted by the executors; the driver gets the features that have a weight and, for each sampled text, which of them it has,
    so what it holds is bounded by the sample.
    """
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    few = few.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    texts = written(rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label")).drop("key"), "toxicity-sample")
    toxic, clean = texts.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    words = associated(word_counts(texts), toxic, clean) if toxic and clean else []
    if not words:
        return Model({}, np.linspace(5, 10, grades - 1))
    place = {w: i for i, (w, _) in enumerate(words)}

    def kernel(batches) -> Iterator[dict]:
        for batch in batches:
            yield {"at": [sorted([place[w] for w in features(t) & place.keys()]) for t in batch.column(0).to_pylist()], "label": batch.column(1)}

    found = map_arrow(texts.select("text", "label"), "at array<int>, label int", kernel).groupBy("label", "at").agg(F.count("*").alias("n")).orderBy("label", "at").collect()
    y, n = np.array([r["label"] for r in found], dtype=int), np.array([r["n"] for r in found], dtype=float)
    sizes = [len(r["at"]) for r in found]
    x = Sparse(np.repeat(np.arange(len(found)), sizes), np.array([i for r in found for i in r["at"]], dtype=int), (len(found), len(words)))
    if y.max() == 1 and grades > 2:
        hits = x.times(np.array([z > 0 for _, z in words], dtype=float))
        cuts = np.quantile(np.repeat(hits[y > 0], n[y > 0].astype(int)), np.arange(1, grades - 1) / (grades - 1))
        y = np.where(y > 0, 1 + (hits[:, None] > cuts).sum(1), 0)
    y = np.minimum(y, grades - 1)
    w, theta = fit_ordinal(x, y, n, grades)
    return Model({word: float(v) for (word, _), v in zip(words, w, strict=True)}, theta)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = TOXIC) -> DataFrame:
    """severity (expected grade), grade (the highest that half the probability reaches), p_toxic (of grade 1 or more) and is_toxic (p_toxic reaches the threshold) of every whole text.

    One row for each row of df, repeated rows and null ids too; null and wordless texts have no features and get the prior. Further columns aren't read. A model that learned nothing calls nothing toxic.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(batches) -> Iterator[dict]:
        m = shared.value
        for batch in batches:
            p = np.array([m(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1)
            yield {"id": batch.column(0), "severity": p.sum(1), "grade": (p >= 0.5).sum(1), "p_toxic": p[:, 0], "is_toxic": p[:, 0] >= threshold}

    return map_arrow(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")), "id long, severity double, grade int, p_toxic double, is_toxic boolean", kernel).withColumnRenamed("id", id_col)
