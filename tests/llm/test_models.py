"""Toxicity, quality, class-based scoring, language identification."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import FOLDER, table
from thermal_lake.llm import brown, language_id, quality, queries, toxicity
from thermal_lake.operators import graph


def test_ordinal_fit_shares_weights_and_orders_thresholds():
    rng = np.random.default_rng(1)
    x = (rng.random((4000, 3)) < 0.3).astype(float)
    eta = x @ np.array([2.0, -1.0, 0.0])
    u = rng.logistic(size=4000)
    y = (eta + u > 0).astype(int) + (eta + u > 1.5) + (eta + u > 3)
    w, t = toxicity.fit_ordinal(x, y, np.ones(4000), 4)
    assert w == pytest.approx([2.0, -1.0, 0.0], abs=0.25)
    assert t == pytest.approx([0.0, 1.5, 3.0], abs=0.25)
    assert (np.diff(t) > 0).all()
    doubled = toxicity.fit_ordinal(np.repeat(x, 2, 0), np.repeat(y, 2), np.ones(8000), 4, penalty=0.2)
    weighted = toxicity.fit_ordinal(x, y, 2 * np.ones(4000), 4, penalty=0.2)
    assert doubled[0] == pytest.approx(weighted[0], abs=1e-4)


def toxic_table(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        rows.append((i, f"alpha beta w{i} gamma " + ("vileword nastyword " * (1 + i % 3) if bad else "kind words")))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_words_and_stems(spark):
    docs, labels = toxic_table(spark)
    m = toxicity.fit(docs, labels)
    assert {"vileword", "nastyword", "^vilew"} <= set(m.weights)
    asked = spark.createDataFrame([(1, "VILEWORD!"), (2, "kind words"), (3, None), (4, "vilewording nastywords")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in toxicity.score(asked, m).collect()}
    assert r[1]["is_toxic"]
    assert not r[2]["is_toxic"]
    assert not r[3]["is_toxic"]
    assert r[1]["severity"] > r[2]["severity"]
    for i, text in ((1, "VILEWORD!"), (4, "vilewording nastywords")):
        total = sum(m.weights[w] for w in toxicity.features(text) if w in m.weights)
        p = [1 / (1 + math.exp(t - total)) for t in m.thresholds]
        assert r[i]["severity"] == pytest.approx(sum(p))
        assert r[i]["grade"] == sum(x >= 0.5 for x in p)


def test_graded_labels_order_the_severity(spark, tmp_path):
    """Grades 0 to 3 are planted by words that say how bad a text is; expected severity follows the planted grade on texts that were not learnt from."""
    rng = random.Random(41)
    bad = [[], ["rude", "silly"], ["nasty", "vulgar"], ["hateful", "violent"]]
    rows = []
    for i in range(3000):
        g = rng.choices(range(4), (6, 2, 1, 1))[0]
        w = [f"word{rng.randrange(300)}" for _ in range(30)] + (rng.choices(bad[g], k=3) if g else []) + (rng.choices(bad[g - 1], k=1) if g > 1 else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), g))
    df = table(spark, tmp_path, rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 2000").select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(df.select("doc_id", "text"), m).collect()}
    by = [[got[i]["severity"] for i, _, g in rows if g == k and i >= 2000] for k in range(4)]
    assert all(np.mean(by[k]) + 0.5 < np.mean(by[k + 1]) for k in range(3))
    assert all(abs(np.mean(x) - k) < 0.25 for k, x in enumerate(by))
    assert np.mean([got[i]["grade"] == g for i, _, g in rows if i >= 2000]) > 0.95


def dense_fit(x, y, n, grades, penalty=0.1):
    """The same likelihood by plain gradient steps with numeric second derivatives: Newton's method on a dense matrix."""
    d = x.shape[1]
    share = [n[y >= k].sum() / n.sum() for k in range(1, grades)]
    v = np.concatenate((np.zeros(d), [-math.log(s / (1 - s)) for s in share]))

    def value_and_slope(v):
        cdf = np.concatenate((np.ones((len(y), 1)), 1 / (1 + np.exp(v[d:] - (x @ v[:d])[:, None])), np.zeros((len(y), 1))), 1)
        p = cdf[np.arange(len(y)), y] - cdf[np.arange(len(y)), y + 1]
        s = cdf * (1 - cdf)
        a, b = s[np.arange(len(y)), y], s[np.arange(len(y)), y + 1]
        slope = np.concatenate((x.T @ (n * (a - b) / p) - penalty * v[:d], [(n * ((y + 1 == k) * b - (y == k) * a) / p).sum() for k in range(1, grades)]))
        return float(n @ np.log(p)) - penalty * v[:d] @ v[:d] / 2, slope

    for _ in range(100):
        f, g = value_and_slope(v)
        h = np.array([(value_and_slope(v + 1e-5 * e)[1] - value_and_slope(v - 1e-5 * e)[1]) / 2e-5 for e in np.eye(len(v))])
        step, size = np.linalg.solve(-h, g), 1.0
        while size > 1e-8:
            new = v + size * step
            if (np.diff(new[d:]) > 0).all() and value_and_slope(new)[0] >= f:
                break
            size /= 2
        v = v + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return v[:d], v[d:]


def test_toxicity_by_brute_force(spark):
    """The whole query in plain Python: features, association, grades, fit and scores."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect():
        labels[r["doc_id"]] = max(r["toxic"], labels.get(r["doc_id"], 0))
    find = lambda t: set(re.findall(r"[^\W\d_]+", (t or "").lower()))
    marks = lambda t: find(t) | {f"^{w[:n]}" for w in find(t) for n in (5, 7) if len(w) > n}
    texts = {}
    for i, y in labels.items():
        if i in docs:
            texts[docs[i]] = max(y, texts.get(docs[i], 0))
    bad, good = sum(texts.values()), len(texts) - sum(texts.values())
    counts = {k: Counter(x for t, y in texts.items() if y == k for x in marks(t)) for k in (0, 1)}
    z = {}
    for x in counts[0].keys() | counts[1].keys():
        a, b = counts[1][x], counts[0][x]
        s = (a + b) / (bad + good)
        z[x] = (a / bad - b / good) / math.sqrt(s * (1 - s) * (1 / bad + 1 / good) + 1e-12)
    words = sorted(x for x, v in z.items() if abs(v) >= 5 and counts[0][x] + counts[1][x] >= 4)
    assert words
    x = np.array([[float(w in marks(t)) for w in words] for t in texts])
    y = np.array(list(texts.values()))
    hits = x @ np.array([z[w] > 0 for w in words], dtype=float)
    cuts = np.quantile(hits[y > 0], [1 / 3, 2 / 3])
    y = np.where(y > 0, 1 + (hits[:, None] > cuts).sum(1), 0)
    got = {r["doc_id"]: r["severity"] for r in queries.op1_toxicity(spark, FOLDER).collect()}
    assert len(set(y)) == 4
    w, theta = dense_fit(x, y, np.ones(len(y)), 4)
    for i, t in docs.items():
        total = sum(v for u, v in zip(words, w, strict=True) if u in marks(t))
        assert got[i] == pytest.approx(sum(1 / (1 + math.exp(k - total)) for k in theta), abs=1e-4)
    assert len(got) == len(docs)


def test_toxicity_with_labels_that_teach_nothing(spark, empty):
    docs, labels = toxic_table(spark, 10)
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))):
        m = toxicity.fit(docs, few)
        assert toxicity.score(docs, m).where("is_toxic").count() == 0
    assert toxicity.score(empty, toxicity.Model({}, np.array([5.0, 6.0, 7.0]))).count() == 0


def test_toxicity_on_the_tables(spark):
    r = queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    clean = [x for x in r if not x["toxic"]]
    assert sum(x["is_toxic"] for x in clean) <= 0.01 * len(clean)
    bad = [x for x in r if x["toxic"]]
    assert sum(x["is_toxic"] for x in bad) >= 0.6 * len(bad)


def test_quality_posteriors_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(rng.integers(1, 40)) if i % 3 else "### $$$ ||| " * 5, f"h{i % 4}", f"p{i % 7}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, q string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    c = quality.fit(df, labels)
    got = {r["doc_id"]: r for r in quality.score(df, c, F.col("h"), F.concat_ws("/", "h", "q")).collect()}
    lo = {i: float(c.log_odds([t])[0]) for i, t, _, _ in rows}
    p = {i: 1 / (1 + math.exp(-v)) for i, v in lo.items()}
    mean = min(max(sum(p.values()) / len(p), 1e-6), 1 - 1e-6)
    assert len(got) == 120
    kept = [got[i]["keep"] for i in range(120)]
    assert sum(k == (i % 3 > 0) for i, k in enumerate(kept)) >= 115

    def k(groups, prior):
        n = np.array([len(v) for v in groups.values()], dtype=float)
        rate = np.array([np.mean([p[i] for i in v]) for v in groups.values()])
        m = np.array([prior[g] for g in groups])
        free = n.sum() - (n**2).sum() / n.sum()
        inside = (rate * (1 - rate)).mean()
        between = max(1e-9, ((n * (rate - m) ** 2).sum() - (len(n) - 1) * inside) / free)
        return float(np.clip(inside / between, 1, 1e6))

    hosts, paths = {}, {}
    for i, _, h, q in rows:
        hosts.setdefault(h, []).append(i)
        paths.setdefault((h, q), []).append(i)
    kh = k(hosts, dict.fromkeys(hosts, mean))
    ph = {h: (sum(p[i] for i in v) + kh * mean) / (len(v) + kh) for h, v in hosts.items()}
    kp = k(paths, {x: ph[x[0]] for x in paths})
    for i, _, h, q in rows:
        v = paths[h, q]
        want = (sum(p[j] for j in v) - p[i] + kp * ph[h]) / (len(v) - 1 + kp)
        want = min(max(want, 1e-6), 1 - 1e-6)
        assert got[i]["p_host"] == pytest.approx(ph[h], rel=1e-6)
        assert got[i]["p_path"] == pytest.approx(want, rel=1e-5)
        z = lo[i] + math.log(want / (1 - want)) - math.log(mean / (1 - mean))
        assert got[i]["quality"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def test_lexicon_by_brute_force(spark):
    rng = random.Random(51)
    rows = [(" ".join(rng.choices(["good", "fine", "Bad", "awful", "the", f"rare{i}"], (3, 2, 1, 1, 3, 1) if i % 3 else (1, 1, 3, 3, 3, 1), k=12)), int(i % 3 > 0)) for i in range(90)] + [(None, 0), ("", 1)]
    got = quality.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(5))
    n = Counter(y for _, y in rows)
    counts = {y: Counter(w for t, k in rows if k == y for w in {w.lower() for w in (t or "").split()}) for y in (0, 1)}
    want = {w: max(-3, min(3, math.log((counts[1][w] + 1) * (n[0] + 2) / ((counts[0][w] + 1) * (n[1] + 2))))) for w in counts[0] | counts[1] if counts[0][w] + counts[1][w] >= 4}
    assert got == pytest.approx(want)
    assert got["good"] > 0 > got["awful"]
    assert quality.lexical(["Good", "good", "unseen"], got) == [got["good"], 0.5]
    assert quality.lexical(["unseen"], got) == [0.0, 0.0]


def test_quality_held_out(spark):
    """Labels of a third of the ids are left out of learning; the classifier is right on 0.95 of them at least."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    c = quality.fit(docs, labels.where(~held))
    rows = docs.join(labels.where(held).select("doc_id", "quality"), "doc_id").select("text", "quality").limit(4000).collect()
    assert len(c.lexicon) > 100
    y = np.array([r["quality"] for r in rows]) > 0
    right = float(((c.log_odds([r["text"] for r in rows]) > 0) == y).mean())
    print(f"quality: {len(rows)} held-out labels, {right:.4f} right, {float(max(y.mean(), 1 - y.mean())):.4f} by the larger class")
    assert right >= 0.95


def test_quality_edges(spark, odd, empty):
    c = quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    r = quality.score(odd, c, F.col("source"), F.concat_ws("/", "source", "lang"))
    assert r.count() == odd.count()
    assert r.where("quality IS NULL OR isnan(quality)").count() == 0
    assert quality.score(empty, c, F.col("source"), F.col("lang")).count() == 0


TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [""]


def base_of(rows, learn):
    counts = Counter(w for i, t in rows if learn(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return counts, n, lambda t: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))


def test_base_scores_are_exact_and_the_model_beats_them(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    counts, n, base = base_of(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    got = {r["doc_id"]: r for r in queries.op3_brown_score(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, ts = got[i], tokens(t)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(counts[w] > 0 for w in ts), n)
        assert r["base_score"] == pytest.approx(base(t), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_model_is_a_distribution(spark, monkeypatch):
    """All next words of the vocabulary, and one for what is unseen in each unit, add up to 1 after any word."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in "klmnp" for b in ("ing", "ate", "ous", "ed")]
    texts = [" ".join(rng.choice(vocabulary, 30, p=np.arange(20, 0, -1) / 210)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(brown, "UNIT_LEAST", 70)
    monkeypatch.setattr(brown, "TABLE", 14)
    monkeypatch.setattr(brown, "CORE_SHARE", 0.07)
    monkeypatch.setattr(brown, "SUFFIX_SHARE", 0.01)
    seen = {}
    original = brown.Model.fit.__func__
    monkeypatch.setattr(brown.Model, "fit", classmethod(lambda cls, e, w, c=8: seen.setdefault("m", (w, original(cls, e, w, 8)))[1]))
    got = {r["doc_id"]: r["score"] for r in brown.score(df, F.lit(True), classes=8).collect()}
    words, model = seen["m"]
    units = np.bincount(model.cls, weights=10**model.emission, minlength=8)
    assert units[np.bincount(model.cls, minlength=8) > 0] == pytest.approx(1.0)
    assert (10**model.transition).sum(1) == pytest.approx(1.0)
    counts = Counter(w for t in texts for w in t.split())
    own = {w for w in counts if w.encode() in words.known and counts[w] >= 70}
    unit = lambda w: words.known[w.encode()] + 1 if w in own else words.suffixes.get(w.encode()[-3:], words.other)
    assert 0 < len(own) < len(words.known) <= 14 < len(counts)
    assert words.suffixes
    for u in {unit(w) for w in counts if w not in own}:
        assert sum((counts[w] + 1) * 10 ** -words.log_mass[u] for w in counts if unit(w) == u) + 10 ** -words.log_mass[u] == pytest.approx(1.0)
    for i, t in enumerate(texts):
        before, total = brown.END_CLASS, 0.0
        for w in [*t.split(), None]:
            u = brown.END_UNIT if w is None else unit(w)
            within = 0.0 if w is None or w in own else math.log10(counts[w] + 1) - words.log_mass[u]
            total += model.transition[before, model.cls[u]] + model.emission[u] + within
            before = model.cls[u]
        assert got[i] == pytest.approx(total, rel=1e-9)


def word_pairs(texts, unit, size):
    pairs = np.zeros((size, size))
    for t in texts:
        at = 0
        for w in [*t.split(), None]:
            u = 0 if w is None else unit(w)
            pairs[at, u] += 1
            at = u
    return pairs


def zipf_texts(seed=4, n=300):
    """Words of six kinds that follow each other by kind."""
    rng = np.random.default_rng(seed)
    follow = rng.dirichlet(np.full(6, 0.25), 6)
    texts = []
    for _ in range(n):
        kind, out = 0, []
        for _ in range(40):
            kind = rng.choice(6, p=follow[kind])
            out.append(f"k{kind}w{min(39, int(rng.pareto(0.9)))}")
        texts.append(" ".join(out))
    return texts


def fitted(spark, texts, classes, monkeypatch, core):
    monkeypatch.setattr(brown, "CORE_SHARE", core)
    monkeypatch.setattr(brown, "UNIT_LEAST", 1)
    seen = {}
    original = brown.Model.fit.__func__
    with monkeypatch.context() as m:
        m.setattr(brown.Model, "fit", classmethod(lambda cls, e, w, c: seen.setdefault("m", (w, original(cls, e, w, c)))[1]))
        brown.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(True), classes=classes)
    words, model = seen["m"]
    return words, model, word_pairs(texts, lambda w: words.known[w.encode()] + 1, len(words.counts))


def of_classes(pairs, cls, classes):
    one = np.eye(classes)[cls]
    return brown.likelihood(one.T @ pairs @ one)


def test_staged_exchange_against_the_sequential_one(spark, monkeypatch):
    """All units one after the other (every one is core) is plain exchange of the whole matrix; the stages come close to its likelihood, and far above classes by frequency."""
    texts, classes = zipf_texts(), 8
    words, model, pairs = fitted(spark, texts, classes, monkeypatch, 0.0)
    order = np.argsort(-words.counts[1:-1], kind="stable") + 1
    at = np.concatenate(([0], order, [len(words.counts) - 1]))
    plain = np.zeros(len(words.counts), dtype=int)
    plain[at] = brown.exchange(pairs[np.ix_(at, at)], classes)
    if (words.counts[-1] == 0) and (plain == classes).sum() == 1:
        plain[plain == classes] = model.cls[-1]
    assert (model.cls[:-1] == plain[:-1]).all()
    best = of_classes(pairs, model.cls, classes)
    words, staged, pairs = fitted(spark, texts, classes, monkeypatch, 0.01)
    alone = of_classes(pairs, np.zeros(len(words.counts), dtype=int), classes)
    frequent = np.where(np.arange(len(words.counts)) == 0, 0, 1 + np.argsort(np.argsort(-words.counts, kind="stable"), kind="stable") % (classes - 1))
    assert (words.counts[1:-1] < 0.01 * words.total).sum() > 20
    assert of_classes(pairs, staged.cls, classes) - alone > 0.8 * (best - alone) > 4 * (of_classes(pairs, frequent, classes) - alone)


def test_a_step_takes_the_class_of_the_greatest_likelihood(spark):
    rng = np.random.default_rng(8)
    units, width = 30, 5
    pairs = np.where(rng.random((units, units)) < 0.3, rng.integers(1, 20, (units, units)), 0)
    cls = rng.integers(0, width, units)
    one = np.eye(width)[cls]
    counts = np.zeros((units, 2 * width + 1), dtype=int)
    for u in range(units):
        for v in range(units):
            if u == v:
                counts[u, 2 * width] += pairs[u, u]
            else:
                counts[u, cls[v]] += pairs[u, v]
                counts[u, width + cls[v]] += pairs[v, u]
    rows = [(u, s, int(counts[u, s])) for u in range(units) for s in range(2 * width + 1) if counts[u, s]]
    df = spark.createDataFrame(rows, "unit int, slot int, n long").repartition(7)
    got = dict(zip(*brown.stepped(df, one.T @ pairs @ one, cls, [0]), strict=True))
    for u in range(units):
        values = []
        for k in range(1, width):
            moved = cls.copy()
            moved[u] = k
            values.append(of_classes(pairs, moved, width))
        assert values[got[u] - 1] == pytest.approx(max(values), rel=1e-12)


def test_sided_counts_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(brown, "CODES", 6)
    rng = np.random.default_rng(9)
    texts = [rng.integers(1, 12, rng.integers(0, 30)).tolist() + [0] for _ in range(50)]
    cls, width, wanted = rng.integers(0, 4, 12), 4, np.arange(12) % 3 != 1
    got = {(r["unit"], r["slot"]): r["n"] for r in brown.sided_counts(spark.createDataFrame([(t, True) for t in texts] + [([3, 4, 0], False)], "units array<int>, learn boolean").repartition(3), cls, wanted, width).collect()}
    want = Counter()
    for t in texts:
        for a, b in zip([0, *t], t, strict=False):
            if a == b:
                want[a, 2 * width] += int(wanted[a])
                continue
            if wanted[a]:
                want[a, cls[b]] += 1
            if wanted[b]:
                want[b, width + cls[a]] += 1
    assert got == +want


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(brown, "TABLE", 1)
    monkeypatch.setattr(graph, "HOT_ROWS", 1)
    rows = [(0, "aa aa bb cc"), (1, "aa bb dd"), (2, "dd zz cc cc")]
    counts, n, base = base_of(rows, lambda i: i < 2)
    got = {r["doc_id"]: r for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 2).collect()}
    for i, t in rows:
        assert got[i]["base_score"] == pytest.approx(base(t))
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in tokens(t))


def test_exchange_raises_the_likelihood():
    pairs = np.zeros((8, 8))
    for a in (1, 2, 3):
        for b in (4, 5, 6):
            pairs[a, b] = pairs[b, a] = 10
    pairs[0, 1:4], pairs[4:7, 0] = 5, 5
    cls = brown.exchange(pairs, 3)
    assert len(set(cls[1:4])) == 1
    assert len(set(cls[4:7])) == 1
    assert cls[1] != cls[4]


def test_scores_of_odd_rows(spark, odd, empty):
    r = brown.score(odd, F.lit(True)).collect()
    assert len(r) == odd.count()
    blank = [x for x in r if x["doc_id"] in (1, 2, 3)]
    assert all(x["n_tokens"] == 1 for x in blank)
    none = brown.score(odd, F.lit(False)).collect()
    assert all(x["train_tokens"] == 0 and x["base_score"] == 0 for x in none)
    assert all(math.isfinite(x["score"]) for x in [*r, *none])
    assert brown.score(empty, F.lit(True)).count() == 0


def test_languages_held_out(spark):
    r = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in r)
    assert sum(x["lang"] == x["lang_pred"] for x in held) >= 0.98 * len(held)
    assert all(0 <= x["score"] <= 1 for x in r)


def languages_one_by_one(train, asked, gram_share=language_id.GRAM_SHARE):
    """language and score of each text, in plain Python, from every count."""
    find = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    cut = lambda w, n: [x[i : i + n] for x in [f"^{w}$" if n > 1 else w] for i in range(len(x) - n + 1)]
    counts = {}
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(find(text))
    langs = sorted(x for x, c in counts.items() if c)
    of = {n: {x: Counter(g for w in counts[x] for g in cut(w, n)) for x in langs} for n in range(1, 5)}
    size = {n: {x: sum(c.values()) for x, c in of[n].items()} for n in of}
    known = {n: {g for x in langs for g, k in of[n][x].items() if k >= gram_share * size[n][x]} for n in of}
    total = {x: sum(counts[x].values()) for x in langs}

    def weight(w):
        if any(w in counts[x] for x in langs):
            return [math.log((counts[x][w] + 0.5) / (total[x] + 1)) for x in langs]
        for n in range(min(4, len(w) + 2), 0, -1):
            found = [g for g in cut(w, n) if g in known[n]]
            if found and 2 * len(found) >= len(cut(w, n)):
                return [sum(math.log((of[n][x][g] + 0.5) / (size[n][x] + 1)) for g in found) / len(found) for x in langs]
        return [0.0] * len(langs)

    out = []
    for text in asked:
        if not langs or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        sums = [sum(x) for x in zip(*map(weight, find(text)), strict=True)]
        best = max(sums)
        p = [math.exp((x - best) / math.sqrt(len(find(text)))) for x in sums]
        out.append((langs[sums.index(best)], 1 / sum(p)))
    return out


@pytest.mark.parametrize("table", [language_id.TABLE, 500, 0])
def test_languages_by_brute_force(spark, docs, monkeypatch, table):
    monkeypatch.setattr(language_id, "TABLE", table)
    monkeypatch.setattr(graph, "HOT_ROWS", 20)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    learnt = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2 and x is not None]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op8_language_id(spark, FOLDER).collect()}
    want = dict(zip([i for i, _, _ in rows], languages_one_by_one(learnt, [t for _, t, _ in rows]), strict=True))
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in got)


@pytest.mark.parametrize("table", [300, 0])
def test_labels_are_the_predictions(spark, docs, monkeypatch, table):
    """What the table decides alone, and what is joined, is what predict() says."""
    monkeypatch.setattr(language_id, "TABLE", table)
    mixed = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.expr("concat_ws(' ', reverse(slice(split(text, ' '), 1, 6)))")))
    m = language_id.learn(docs.where("doc_id % 3 <> 0"))
    want = Counter((r["doc_id"], r["lang_pred"]) for r in language_id.predict(mixed, m).collect() if r["lang_pred"] != "und")
    got = language_id.label(mixed, m)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["lang"]) for r in got.collect()) == want
    sure = [r["sure"] for r in language_id.tallied(mixed.select("text"), "text", m, False).collect()]
    assert min(sure) == -1
    assert table == 0 or max(sure) >= 0


def test_every_known_word_scores_by_its_own_counts(spark, monkeypatch):
    """A word that the table has no room for."""
    monkeypatch.setattr(language_id, "TABLE", 2)
    train = [(0, "aa " * 40 + "rare rare rare", "x"), (1, "bb " * 40 + "rare " * 9, "y"), (2, "cc", None)]
    m = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert set(m.index) & {"aa", "bb", "rare"} == {"aa", "bb"}
    assert {r["word"] for r in m.rest.collect()} == {"rare"}
    asked = ["rare", "aa rare", "bb rare", "rarely", "日本", None, "12 ½ ²!"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), m).orderBy("doc_id").collect()
    want = languages_one_by_one([(t, x) for _, t, x in train if x], asked)
    assert [(r["lang_pred"], pytest.approx(r["score"])) for r in got] == want
    assert want[4] == ("x", 0.5)
    assert want[5] == want[6] == ("und", 0.0)


def test_unseen_words_back_off(spark):
    rows = [(i, "sch" + "aeiou"[i % 5] + "tz " * 3, "de") for i in range(20)] + [(50 + i, "qu" + "aeiou"[i % 5] + "eaux " * 3, "fr") for i in range(20)] + [(99, "x", None)]
    m = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == ["de", "fr"]
    assert "schmutz" not in m.index
    asked = spark.createDataFrame([(1, "schwutz schmitz"), (2, "queaux eaux"), (3, "日本")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(asked, m).collect()}
    assert (got[1][0], got[2][0], got[3]) == ("de", "fr", ("de", 0.5))


def test_languages_of_odd_rows(spark, odd, empty):
    m = language_id.learn(odd.where("text IS NOT NULL"))
    r = language_id.predict(odd, m).collect()
    assert len(r) == odd.count()
    assert all((x["lang_pred"] == "und") for x in r if x["doc_id"] in (1, 2, 3, 4))
    nothing = language_id.learn(odd.where("false"))
    assert {x["lang_pred"] for x in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(empty, m).count() == 0
    for model in (m, nothing):
        kept = language_id.label(odd, model)
        assert kept.schema == odd.schema or kept.columns == odd.columns
        assert kept.where("doc_id IN (1, 2, 3, 4)").count() == 0
        assert kept.where("doc_id = 5").count() == (2 if model is m else 0)
    assert {r["lang"] for r in language_id.label(odd, m).collect()} <= set(m.langs)
    assert language_id.label(odd.drop("lang"), m).columns == odd.drop("lang").columns
    assert language_id.label(empty, m).count() == 0
