"""Text scoring by a class-based bigram model whose classes exchange clustering finds (operator 3).

Every token belongs to a unit: a word with UNIT_LEAST occurrences is a unit of its own (the TABLE most frequent ones, if there are more), any other word belongs to the unit of its last three
bytes, as so few bigrams of its own say less of it than its ending does. Exchange clustering assigns units to classes by their own bigrams: the most frequent ones one after the other until none moves, all others by executors, at once, against the classes found; then all units make such a step
together. A text's probability is the product, over its tokens and the end, of
P(class | class before) P(unit | class) P(word | unit). All counts are of the whole learning part of the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermal_lake.llm.common import least_count, map_arrow, written
from thermal_lake.operators import graph

#: The end of a text, among the words, the units and the classes.
END, END_UNIT, END_CLASS = b"", 0, 0
CLASSES = 64
#: Words that executors get by broadcast, and that are units, at most: the most frequent ones.
TABLE = 500_000
#: Occurrences from which a word is a unit.
UNIT_LEAST = 20
#: Shares of all tokens from which a word ending is a unit, and from which a unit takes part in the exchange one after the other: at most 1/share are.
SUFFIX_SHARE, CORE_SHARE = 1e-4, 5e-4
SUFFIX = 3
#: Exchange steps of all units at once that follow.
ROUNDS = 1
#: Distinct words, and codes, that a counting task holds before it hands on what it has.
HELD, CODES = 400_000, 4_000_000


def tokens(data: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (bytes.lower() and bytes.split() know ASCII alone)."""
    return data.lower().split() if data else []


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end of a text among them."""

    def kernel(batches) -> Iterator[dict]:
        held: Counter = Counter()
        for batch in batches:
            held[END] += batch.num_rows
            for data in batch.column(0).to_pylist():
                held.update(tokens(data))
            if len(held) > HELD:
                yield {"word": list(held), "n": list(held.values())}
                held.clear()
        yield {"word": list(held), "n": list(held.values())}

    return map_arrow(texts, "word binary, n long", kernel).where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """What encoding needs. known: the place in the arrays of a word with `least` occurrences or more; suffixes: an ending's unit; counts: tokens of each unit."""

    total: int
    types: int
    ends: int
    least: int
    known: dict[bytes, int]
    unit: np.ndarray
    log_count: np.ndarray
    within: np.ndarray
    suffixes: dict[bytes, int]
    other: int
    log_mass: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, vocabulary: DataFrame) -> Words:
        total, types, ends = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
        inner = vocabulary.where(F.col("word") != F.lit(END))
        least = least_count(inner, TABLE)
        rows = inner.where(F.col("n") >= least).toArrow()
        found, n = rows.column("word").to_pylist(), rows.column("n").to_numpy().astype(np.int64)
        order = np.lexsort((np.array([*found, None], dtype=object)[:-1], -n)) if found else np.zeros(0, dtype=int)
        found, n = [found[i] for i in order], n[order]
        tail = inner.where(F.col("n") < max(least, UNIT_LEAST)).groupBy(F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})").alias("suffix")).agg(F.sum("n").alias("mass"), F.count("*").alias("types"))
        kept = tail.where(F.col("mass") >= SUFFIX_SHARE * total).orderBy("suffix").collect()
        mass, kinds = tail.agg(F.coalesce(F.sum("mass"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
        first = 1 + int((n >= UNIT_LEAST).sum())
        other = first + len(kept)
        suffixes = {bytes(r["suffix"]): first + i for i, r in enumerate(kept)}
        counts, size = np.zeros(other + 1, dtype=np.int64), np.ones(other + 1)
        counts[END_UNIT], counts[1:first] = ends, n[: first - 1]
        for i, r in enumerate(kept):
            counts[first + i], size[first + i] = r["mass"], r["mass"] + r["types"] + 1
        counts[other] = mass - sum(r["mass"] for r in kept)
        size[other] = counts[other] + kinds - sum(r["types"] for r in kept) + 1
        log_mass, log_count = np.log10(size), np.log10(n + 1.0)
        unit, within = np.arange(1, len(found) + 1, dtype=np.int32), np.zeros(len(found))
        for i in range(first - 1, len(found)):
            unit[i] = suffixes.get(found[i][-SUFFIX:], other)
            within[i] = log_count[i] - log_mass[unit[i]]
        return cls(total, types, ends, least, {w: i for i, w in enumerate(found)}, unit, log_count, within, suffixes, other, log_mass, counts)

    @property
    def log_base(self) -> float:
        return float(np.log10(self.total + self.types + 1.0))


def encode(rows: DataFrame, words: Words) -> DataFrame:
    """rows (row, id, learn, data) as units, with the sums that need no further lookup and the words whose counts are still to be looked up."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    schema = "row long, id long, learn boolean, n_tokens long, n_known long, log_count double, within double, units array<int>, rare array<binary>, times array<int>"

    def kernel(batches) -> Iterator[dict]:
        w = shared.value
        log_end = float(np.log10(w.ends + 1.0))
        for batch in batches:
            texts = [tokens(x) for x in batch.column(3).to_pylist()]
            flat = [t for x in texts for t in x]
            sizes = np.array([len(x) for x in texts], dtype=np.int64)
            of = np.repeat(np.arange(len(texts)), sizes)
            at = np.fromiter(map(w.known.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
            seen = at >= 0
            unknown = np.flatnonzero(~seen)
            units = np.empty(len(flat), dtype=np.int32)
            units[seen] = w.unit[at[seen]]
            units[unknown] = [w.suffixes.get(flat[i][-SUFFIX:], w.other) for i in unknown]
            add = lambda mask, x: np.bincount(of[mask], weights=x, minlength=len(texts))
            ends = np.cumsum(sizes + 1)
            whole = np.full(len(flat) + len(texts), END_UNIT, dtype=np.int32)
            whole[np.arange(len(flat)) + of] = units
            rare: list[Counter] = [Counter() for _ in texts]
            for i in unknown:
                rare[of[i]][flat[i]] += 1
            yield {
                "row": batch.column(0), "id": batch.column(1), "learn": batch.column(2), "n_tokens": sizes + 1,
                "n_known": np.bincount(of[seen], minlength=len(texts)) + (w.ends > 0), "log_count": add(seen, w.log_count[at[seen]]) + log_end,
                "within": add(seen, w.within[at[seen]]) - add(unknown, w.log_mass[units[unknown]]),
                "units": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(whole)),
                "rare": [list(c) for c in rare], "times": [list(c.values()) for c in rare],
            }

    return map_arrow(rows, schema, kernel)


def pair_counts(encoded: DataFrame, codes, size: int) -> dict[int, int] | tuple[np.ndarray, np.ndarray]:
    """How often each code comes up; codes(before, unit) gives the codes of adjacent units. size bounds the rows that return."""

    def kernel(batches) -> Iterator[dict]:
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            units, starts = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()[: len(lists) + 1])
            if not len(units):
                continue
            before = np.empty_like(units)
            before[1:] = units[:-1]
            before[np.concatenate(([0], np.cumsum(starts)[:-1]))] = END_UNIT
            code, n = np.unique(codes(before, units), return_counts=True)
            keep = code >= 0
            held[code[keep]] += n[keep]
        at = np.flatnonzero(held)
        yield {"code": at, "n": held[at]}

    found = map_arrow(encoded.where("learn").select("units"), "code long, n long", kernel).groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return found.column("code").to_numpy(), found.column("n").to_numpy()


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: float = 0.0) -> np.ndarray:
    """For each class, what adding a unit gains in likelihood: table holds the class bigrams without it; right and left the unit's bigrams with classes after and before it, own those with itself."""
    k = np.arange(len(table))
    rows, columns = table + right, table.T + left
    rows[k, k] += left + own  # inside the class both kinds and the unit's own pairs meet
    gain = xlogx(rows).sum(1) + xlogx(columns).sum(1) - xlogx(columns[k, k]) - xlogx(table).sum(1) - xlogx(table.T).sum(1) + xlogx(table[k, k])
    # classes before the unit have its left bigrams among what follows them whatever class it gets, and so on
    out, into = table.sum(1) + left, table.sum(0) + right
    return gain - xlogx(out + right.sum() + own) + xlogx(out) - xlogx(into + left.sum() + own) + xlogx(into)


def exchange(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Classes of the units whose bigram counts are given. Unit 0 (the end) stays in class 0, the last unit (all the rest) in a class of its own after the others; every other one moves to the class where the likelihood is greatest, until none moves."""
    n = len(pairs)
    cls = np.zeros(n, dtype=np.int64)
    cls[1 : n - 1] = 1 + np.arange(n - 2) % (classes - 1)
    cls[n - 1] = classes
    one = np.zeros((n, classes + 1))
    one[np.arange(n), cls] = 1
    table = one.T @ pairs @ one
    least = 1e-10 * float(xlogx(pairs.sum()))  # below that, a gain is rounding
    moved = 1
    while moved:
        moved = 0
        for u in range(1, n - 1):
            old, own = cls[u], pairs[u, u]
            one[u, old] = 0
            right, left = pairs[u] @ one, pairs[:, u] @ one
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            gain = gains(table, right, left, own)
            gain[[END_CLASS, classes]] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + least:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            one[u, new], cls[u] = 1, new
            moved += new != old
    return cls


def sided_counts(encoded: DataFrame, cls: np.ndarray, wanted: np.ndarray, width: int) -> DataFrame:
    """(unit, slot, n): how often each wanted unit stands before another unit of class `slot`, (slot - width) after one, or (2 width) before itself; added up within tasks first, in bounded arrays."""
    shared, stride = encoded.sparkSession.sparkContext.broadcast((cls.astype(np.int16), wanted)), 2 * width + 1

    def kernel(batches) -> Iterator[dict]:
        of, ask = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            lists = batch.column(0)
            units, starts = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()[: len(lists) + 1])
            if not len(units):
                continue
            before = np.empty_like(units)
            before[1:] = units[:-1]
            before[np.concatenate(([0], np.cumsum(starts)[:-1]))] = END_UNIT
            same = before == units
            first, second = before.astype(np.int64) * stride, units.astype(np.int64) * stride
            code = np.concatenate(((first + of[units])[ask[before] & ~same], (second + width + of[before])[ask[units] & ~same], (second + 2 * width)[ask[units] & same]))
            code, n = np.unique(code, return_counts=True)
            held.append((code, n))
            if sum(len(c) for c, _ in held) > CODES:
                held[:] = [merged()]
                if len(held[0][0]) > CODES // 2:
                    yield {"unit": held[0][0] // stride, "slot": held[0][0] % stride, "n": held[0][1]}
                    held.clear()
        if held:
            code, n = merged()
            yield {"unit": code // stride, "slot": code % stride, "n": n}

    return map_arrow(encoded.where("learn").select("units"), "unit int, slot int, n long", kernel).groupBy("unit", "slot").agg(F.sum("n").alias("n"))


def stepped(counts: DataFrame, table: np.ndarray, cls: np.ndarray, forbidden: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Units of counts (see sided_counts) and the class each would choose, all at once, if all others stayed; cls: the classes they are in now, which they leave first."""
    width = len(table)
    shared = counts.sparkSession.sparkContext.broadcast((table, cls))

    def kernel(batches) -> Iterator[dict]:
        whole, now = shared.value
        last: tuple[int, np.ndarray] | None = None

        def choose(u: int, slots: np.ndarray) -> int:
            right, left, own = slots[:width], slots[width : 2 * width], slots[2 * width]
            t = whole.copy()
            t[now[u]] -= right
            t[:, now[u]] -= left
            t[now[u], now[u]] -= own
            gain = gains(t, right, left, own)
            gain[forbidden] = -np.inf
            return int(gain.argmax())

        for batch in batches:
            unit, slot, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(unit):
                continue
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            out: list[tuple[int, int]] = []
            for s, e in zip(starts, np.append(starts[1:], len(unit)), strict=True):
                if last is None or last[0] != unit[s]:
                    if last is not None:
                        out.append((last[0], choose(*last)))
                    last = int(unit[s]), np.zeros(2 * width + 1)
                last[1][slot[s:e]] += n[s:e]
            yield {"unit": [u for u, _ in out], "cls": [c for _, c in out]}
        if last is not None:
            yield {"unit": [last[0]], "cls": [choose(*last)]}

    dealt = counts.repartition("unit").sortWithinPartitions("unit")
    found = map_arrow(dealt, "unit int, cls int", kernel, rows=1 << 16).toArrow()
    return found.column("unit").to_numpy(), found.column("cls").to_numpy()


def likelihood(table: np.ndarray) -> float:
    """What of the class bigrams' log likelihood depends on the classes."""
    return float(xlogx(table).sum() - xlogx(table.sum(1)).sum() - xlogx(table.sum(0)).sum())


def class_table(encoded: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    code, n = pair_counts(encoded, lambda before, unit: cls[before] * classes + cls[unit], classes * classes)
    table = np.zeros(classes * classes)
    table[code] = n
    return table.reshape(classes, classes)


def cluster(encoded: DataFrame, counts: np.ndarray, total: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """A class for every unit, and the class bigrams: exchange among the most frequent ones, a step for all others by their bigrams with the classes found, and steps of all units at once, taken while the likelihood rises."""
    units = len(counts)
    core = np.flatnonzero((counts >= CORE_SHARE * total) & (np.arange(units) != END_UNIT))
    core = core[np.argsort(-counts[core], kind="stable")]
    k = len(core) + 2
    place = np.full(units, k - 1, dtype=np.int64)
    place[END_UNIT], place[core] = 0, np.arange(1, k - 1)
    code, n = pair_counts(encoded, lambda before, unit: place[before] * k + place[unit], k * k)
    pairs = np.zeros(k * k)
    pairs[code] = n
    pairs = pairs.reshape(k, k)
    found = exchange(pairs, classes)
    cls = found[place]
    rest = cls == classes
    if not rest.any():
        return cls, class_table(encoded, cls, classes)
    one = np.zeros((k, classes + 1))
    one[np.arange(k), found] = 1
    unit, new = stepped(sided_counts(encoded, cls, rest, classes + 1), one.T @ pairs @ one, cls, [END_CLASS, classes])
    cls[rest] = 1 if classes > 1 else 0
    cls[unit] = new
    table, all_units = class_table(encoded, cls, classes), np.arange(units) != END_UNIT
    for _ in range(ROUNDS):
        unit, new = stepped(sided_counts(encoded, cls, all_units, classes), table, cls, [END_CLASS])
        moved = cls.copy()
        moved[unit] = new
        now = class_table(encoded, moved, classes)
        if likelihood(now) <= likelihood(table):
            break
        cls, table = moved, now
    return cls, table


@dataclass
class Model:
    """log10 of P(class | class before) and P(unit | class)."""

    cls: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    @classmethod
    def fit(cls, encoded: DataFrame, words: Words, classes: int = CLASSES) -> Model:
        of, table = cluster(encoded, words.counts, words.total, classes)
        mass, size = np.bincount(of, weights=words.counts, minlength=classes), np.bincount(of, minlength=classes)
        prior = (mass + 1) / (mass.sum() + classes)
        smooth = float(classes)
        transition = (table + smooth * prior) / (table.sum(1, keepdims=True) + smooth)
        return cls(of, np.log10(transition), np.log10((words.counts + 1) / (mass + size)[of]))


def score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """Log10 probability of every whole text, under a model of the rows where learn holds.

    Columns: the id, n_tokens (with the end), n_known (tokens that the learning rows hold), train_tokens, base_score (add-one unigrams), score (the class-based
    model), perplexity (of score). One row for each row of df, repeated rows and null ids too; null text counts as empty
    and has the end alone; further columns aren't read. With no learning row all counts are 0: base_score is 0.
    Words beyond TABLE are looked up by a join on the word, of which hot ones are split.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("data"))
    vocabulary = written(count_words(rows.where("learn").select("data")), "brown-words")
    words = Words.read(vocabulary)
    encoded = written(encode(rows, words), "brown-units")
    model = Model.fit(encoded, words, classes)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(batches) -> Iterator[dict]:
        m = shared.value
        for batch in batches:
            lists = batch.column(6)
            units, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()[: len(lists) + 1])
            if len(units):
                cls = m.cls[units]
                before = np.empty_like(cls)
                before[1:] = cls[:-1]
                before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = END_CLASS
                part = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=m.transition[before, cls] + m.emission[units], minlength=len(sizes))
            else:
                part = np.zeros(len(sizes))
            yield {n: batch.column(i) for i, n in enumerate(("row", "id", "n_tokens", "n_known", "log_count"))} | {"model": part + batch.column(5).to_numpy()}

    scored = map_arrow(encoded.select("row", "id", "n_tokens", "n_known", "log_count", "within", "units"), "row long, id long, n_tokens long, n_known long, log_count double, model double", kernel)
    rare = encoded.selectExpr("row", "inline(arrays_zip(rare, times))")
    known = vocabulary.where(F.col("n") < words.least)
    rare = graph.looked_up(rare, "rare", "row", known, "word", graph.hot_keys(rare, "rare", encoded.agg(F.coalesce(F.sum(F.size("rare")), F.lit(0))).first()[0]))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("log_count") + more - F.col("n_tokens") * F.lit(words.log_base)).alias("base_score"), (F.col("model") + more).alias("score"),
        F.pow(F.lit(10.0), -(F.col("model") + more) / F.col("n_tokens")).alias("perplexity"),
    )
