"""Quality by hierarchical empirical Bayes: a text's own evidence, its path's and its host's (operator 2)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermal_lake.llm.common import map_arrow, scratch, written

#: Labelled rows that are learnt from at most, by the hash of their id: the documented bound of the learning sample.
SAMPLE = 20_000
FEATURES = ("log_words", "letters", "marks", "distinct", "upper", "word_length", "bars", "line_words", "digits", "repeats", "lexical", "familiar", "bias")
#: Labelled texts that a word of the lexicon needs, and the greatest evidence (log odds of good against bad) that a word gives.
LEAST_TEXTS, MOST_ODDS = 4, 3.0
#: Distinct words that a counting task holds before it hands on what it has.
HELD = 300_000


def lexical(words: list[str], lexicon: dict[str, float]) -> list[float]:
    """The mean log odds of a text's distinct words that the lexicon has, and the share of its distinct words that it has."""
    distinct = {w.lower() for w in words}
    found = [lexicon[w] for w in distinct if w in lexicon]
    return [sum(found) / len(found) if found else 0.0, len(found) / len(distinct)]


def evidence(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Numbers that tell prose from junk, each near 0 to 1: its shape, and what labelled texts say of its words."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    joined = "".join(words)
    size = len(joined)
    plain = sum(map(str.isalpha, words))
    distinct = len(set(words))
    marks = sum([joined.count(c) for c in "#$%&*!|<>{}[]=+~^@"])
    digits = sum([joined.count(c) for c in "0123456789"])
    most = max(words.count(w) for w in (words[0], words[n // 2], words[-1]))
    return [math.log10(n) / 4, plain / n, min(1.0, marks / n), distinct / n * min(1.0, n / 50) + max(0.0, 1 - n / 50), sum(map(str.isupper, words)) / n, min(2.0, size / n / 10), text.count("|") / n, min(2.0, n / (text.count("\n") + 1) / 50), digits / chars, most / n if n >= 20 else 0.0, *lexical(words, lexicon), 1.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method; the last column (the bias) isn't penalised."""
    w, ridge = np.zeros(x.shape[1]), penalty * np.ones(x.shape[1])
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def spread(x: np.ndarray) -> np.ndarray:
    """The numbers, their squares and the products of two (without the bias's)."""
    a = x[:, :-1]
    i, j = np.triu_indices(a.shape[1])
    return np.concatenate((a, a[:, i] * a[:, j], x[:, -1:]), 1)


@dataclass
class Classifier:
    """Weights of the evidence, and the lexicon that its lexical part comes from."""

    weights: np.ndarray
    lexicon: dict[str, float]

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        return np.clip(spread(np.array([evidence(t, self.lexicon) for t in texts]).reshape(len(texts), -1)) @ self.weights, -20, 20)


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Log odds, good against bad and shrunk by one text of each kind, of the words in texts (text, label) that LEAST_TEXTS of them have. Words are counted by the executors; no more return than the sample has."""

    def kernel(batches) -> Iterator[dict]:
        held = (Counter(), Counter())

        def flush() -> dict:
            words = list(held[0].keys() | held[1].keys())
            out = {"word": words, "bad": [held[0][w] for w in words], "good": [held[1][w] for w in words]}
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[int(label > 0)].update({w.lower() for w in (text or "").split()})
            if len(held[0]) + len(held[1]) > HELD:
                yield flush()
        yield flush()

    bad, good = texts.agg(F.count_if(F.col("label") <= 0), F.count_if(F.col("label") > 0)).first()
    counts = map_arrow(texts.select("text", "label"), "word string, bad long, good long", kernel).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("good") + 1) * (bad + 2) / ((F.col("bad") + 1) * (good + 2)))
    found = counts.where(F.col("bad") + F.col("good") >= LEAST_TEXTS).select("word", F.greatest(F.least(odds, F.lit(MOST_ODDS)), F.lit(-MOST_ODDS)).alias("odds")).toArrow()
    return dict(zip(found.column("word").to_pylist(), found.column("odds").to_pylist(), strict=True))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Classifier:
    """A classifier from at most `sample` labelled rows (those whose ids hash least), of the labels whose id and value aren't null. With one class alone, or none, all texts get that class's odds (good, if none).

    Half of the sample (by another hash of the id) makes the lexicon, the other half the weights, so that these see words' evidence as new texts do. What the driver gets is bounded by the sample.
    """
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    few = few.orderBy(F.xxhash64("id"), "id").limit(sample)

    def kernel(batches) -> Iterator[dict]:
        for batch in batches:
            yield {"x": [evidence(t, lexicon) for t in batch.column(0).to_pylist()], "label": batch.column(1)}

    with scratch(df.sparkSession):
        half = F.xxhash64("id", F.lit("lexicon")) % 2 == 0
        rows = written(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").select("text", "label", half.alias("half")).repartition(8), "quality-sample")
        lexicon = learn_lexicon(rows.where("half"))
        found = map_arrow(rows.where("not half").select("text", "label"), "x array<double>, label int", kernel).toArrow()
    y = found.column("label").to_numpy().astype(float)
    x = np.array(found.column("x").to_pylist()).reshape(len(y), len(FEATURES))
    wide = spread(x)
    if not len(y) or y.min() == y.max():
        w = np.zeros(wide.shape[1])
        w[-1] = 5.0 if not len(y) or y[0] > 0 else -5.0
        return Classifier(w, lexicon)
    order = np.lexsort((*x.T, y))
    return Classifier(fit_logistic(wide[order], (y > 0).astype(float)[order]), lexicon)


def shrinkage(groups: DataFrame, mean: Column, n: Column, total: Column) -> Column:
    """Columns n_groups, between and within of grouped sums, to the prior's strength in rows: by moments, 1 to 1e6."""
    rate = total / n
    return groups.agg(F.sum(n * (rate - mean) * (rate - mean)).alias("between"), F.sum(rate * (1 - rate)).alias("within"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("groups"), F.first(mean).alias("m"))


def strength(row) -> float:
    """How many rows a prior is worth: the variance inside groups over that of their means, by moments."""
    if not row["n"] or row["groups"] < 2:
        return 1e6
    free = row["n"] - row["nn"] / row["n"]
    inside = row["within"] / row["groups"]
    between = max(1e-9, (row["between"] - (row["groups"] - 1) * inside) / max(free, 1e-9))
    return float(np.clip(inside / between, 1.0, 1e6))


def score(df: DataFrame, classifier: Classifier, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """quality, keep and what they rest on (p_text, p_path, p_host) for every row of df.

    p_text is the classifier's probability for the text alone. Sums of it by host and path shrink: a host's mean towards that of all rows, a path's
    towards its host's, by prior strengths that the spread of the groups gives (moments); a row's own part is left out of its path's. quality adds the
    path's log odds, against those of all rows, to the text's. keep holds if it reaches the threshold. Null and empty texts have no evidence and are scored as such; a null
    host or path is a group of its own. One row for each row of df, repeated rows and null ids too; further columns aren't read.
    Grouping adds up within tasks first; groups come back by a join on path, which adaptive execution splits if it is skewed.
    """
    shared = df.sparkSession.sparkContext.broadcast(classifier)

    def kernel(batches) -> Iterator[dict]:
        for batch in batches:
            yield {"id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "log_odds": shared.value.log_odds(batch.column(3).to_pylist())}

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    texts = written(map_arrow(rows, "id long, host string, path string, log_odds double", kernel).withColumn("p", 1 / (1 + F.exp(-F.col("log_odds")))), "quality-texts")
    paths = written(texts.groupBy("host", "path").agg(F.sum("p").alias("path_total"), F.count("*").alias("path_n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("path_total").alias("host_total"), F.sum("path_n").alias("host_n"))
    total, n = hosts.agg(F.sum("host_total"), F.sum("host_n")).first()
    mean = float(np.clip((total or 0.0) / (n or 1), 1e-6, 1 - 1e-6))
    k_host = strength(shrinkage(hosts, F.lit(mean), F.col("host_n"), F.col("host_total")).first())
    hosts = hosts.withColumn("p_host", (F.col("host_total") + k_host * mean) / (F.col("host_n") + k_host))
    groups = paths.join(hosts.select("host", "p_host"), "host")
    k_path = strength(shrinkage(groups, F.col("p_host"), F.col("path_n"), F.col("path_total")).first())
    odds = lambda p: F.log(p / (1 - p))
    inside = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    found = texts.join(groups, ["host", "path"]).withColumn("p_path", inside((F.col("path_total") - F.col("p") + k_path * F.col("p_host")) / (F.col("path_n") - 1 + k_path)))
    found = found.withColumn("quality", 1 / (1 + F.exp(-(F.col("log_odds") + odds(F.col("p_path")) - math.log(mean / (1 - mean))))))
    return found.select(F.col("id").alias(id_col), F.col("p").alias("p_text"), "p_path", "p_host", "quality", (F.col("quality") >= threshold).alias("keep"))
