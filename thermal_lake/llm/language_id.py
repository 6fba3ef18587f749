"""Language identification by word-first backoff (operator 8).

A word that the learning rows hold scores by its own log frequency in every language, however rare it is: frequent words come from a table that executors get, the others by a
join on the word. An unseen word falls back to its n-grams, longest first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, repeat
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermal_lake.llm.common import bounded, least_count, map_arrow, releasing, scratch, ship, slices, unused, written
from thermal_lake.operators import graph

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Longest n-gram, in characters, that an unseen word falls back to.
LONGEST = 4
#: Words in the table that executors get, at most: the most frequent ones; the others come by a join. And the
#: share of a language's n-grams of one length from which, in some language, an n-gram is known: 1/share entries at most for each language and length.
TABLE, GRAM_SHARE = 150_000, 1 / 10_000
#: Distinct words that a counting task holds before it hands on what it has.
HELD = 300_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log probabilities by language (columns): rows[index[entry]]; words as they are, n-grams of n characters after the digit n. rest: (word, counts) of the learning rows' other words, each less than `least` times, or None.

    swing[j, k]: by how much a word that isn't in the table can favour language j over k at most.
    """

    langs: list[str]
    index: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    totals: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    swing: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    rest: DataFrame | None = None

    def table(self) -> Model:
        """Without rest, as executors get it."""
        return Model(self.langs, self.index, self.rows, self.totals, self.swing)

    def backoff(self, word: str) -> np.ndarray | None:
        """Log probabilities of an unseen word: the mean over its n-grams of the greatest length at which half of them are known."""
        get = self.index.get
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            of = grams(word, n)
            found = [i for g in of if (i := get(f"{n}{g}")) is not None]
            if found and 2 * len(found) >= len(of):
                return self.rows[found].mean(0)
        return None


def counted(df: DataFrame, entries, langs: int) -> DataFrame:
    """(entry, counts: how often each language has it) of df's rows, added up within tasks first; entries(batch) gives pairs of a language's number and its entries."""

    def kernel(batches) -> Iterator[dict]:
        held = [Counter() for _ in range(langs)]

        def flush() -> dict:
            every = list(set().union(*held))
            out = {"entry": every} | {f"n{j}": [c.get(x, 0) for x in every] for j, c in enumerate(held)}
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for j, found in entries(batch):
                held[j].update(found)
            if sum(map(len, held)) > HELD:
                yield flush()
        yield flush()

    names = [f"n{j}" for j in range(langs)]
    parts = map_arrow(df, ", ".join(["entry string", *(f"{n} long" for n in names)]), kernel)
    return parts.groupBy("entry").agg(*[F.sum(n).alias(n) for n in names]).select("entry", F.array(*names).alias("counts"))


def count_words(df: DataFrame, langs: list[str]) -> DataFrame:
    """Words of rows (lang, text)."""
    at = {x: j for j, x in enumerate(langs)}
    return counted(df, lambda batch: ((at[x], words(t)) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), len(langs))


def count_grams(vocabulary: DataFrame, langs: int) -> DataFrame:
    """N-grams (n, then the n-gram) by how many distinct words of each language have them."""

    def entries(batch):
        for word, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of = [f"{n}{g}" for n in range(1, LONGEST + 1) for g in grams(word, n)]
            for j, n in enumerate(counts):
                if n:
                    yield j, of

    return counted(vocabulary, entries, langs)


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model from the rows whose language isn't null: every word's count in every language, and the n-grams that some language has often enough, with their counts in all. A language without words is not learnt."""
    rows = df.where(df[lang_col].isNotNull()).select(df[lang_col].alias("lang"), df[text_col].alias("text"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model([])
    vocabulary = written(count_words(rows, langs), "langid-words")
    sums = lambda t: [F.coalesce(F.sum(F.get("counts", F.lit(j))), F.lit(0)) for j in range(len(langs))]
    totals = np.zeros((LONGEST + 1, len(langs)))
    totals[0] = list(vocabulary.agg(*sums(vocabulary)).first())
    if not totals.any():
        return Model([])
    found = written(count_grams(vocabulary, len(langs)).withColumn("length", F.substring("entry", 1, 1).cast("int")), "langid-grams")
    for r in found.groupBy("length").agg(*sums(found)).collect():
        totals[r[0]] = r[1:]
    often = reduce(or_, [(F.col("length") == n) & (F.get("counts", F.lit(j)) >= F.lit(max(GRAM_SHARE * totals[n, j], 1e-9))) for n in range(1, LONGEST + 1) for j in range(len(langs))])
    vocabulary = vocabulary.withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    least = least_count(vocabulary, TABLE)
    common = F.col("n") >= least
    keep = np.flatnonzero(totals[0])
    model = Model([langs[j] for j in keep], totals=totals[:, keep])
    parts = []
    for table, length in ((vocabulary.where(common).select("entry", "counts", F.lit(0).alias("length")), 0), (found.where(often).select("entry", "counts", "length"), None)):
        t = table.toArrow()
        for x in t.column("entry").to_pylist():
            model.index[x] = len(model.index)
        counts = np.array(t.column("counts").to_pylist(), dtype=float).reshape(t.num_rows, len(langs))[:, keep]
        parts.append(np.log((counts + 0.5) / (model.totals[np.zeros(t.num_rows, dtype=int) if length == 0 else t.column("length").to_numpy()] + 1)))
    model.rows = np.concatenate(parts)
    size, grams_of = model.totals[0], parts[1]
    seen = np.log((min(least, totals[0].max()) + 0.5) / (size[:, None] + 1)) - np.log(0.5 / (size[None, :] + 1))
    unseen = (grams_of[:, :, None] - grams_of[:, None, :]).max(0) if len(grams_of) else np.zeros_like(seen)
    model.swing = np.maximum(0, np.maximum(seen, unseen))
    rest = vocabulary.where(~common).select(F.col("entry").alias("word"), F.array(*[F.get("counts", F.lit(int(j))) for j in keep]).alias("counts"))
    model.rest = None if rest.isEmpty() else rest
    return model


def tallied(df: DataFrame, text_col: str, model: Model, whole: bool) -> DataFrame:
    """df with what the table says of each text: n (words), letters, known (sums by language), rare and times (words that the table doesn't have; none if there is no rest, for then they back off here), and sure: the number of the
    language that no rare word can change any more, or -1. whole keeps the text."""
    shared, k, joins = df.sparkSession.sparkContext.broadcast(model.table()), len(model.langs), model.rest is not None
    at, keep = df.columns.index(text_col), [i for i, c in enumerate(df.columns) if whole or c != text_col]
    own = StructType([df.schema[i] for i in keep])
    schema = StructType.fromDDL(TALLY)
    out = to_arrow_schema(schema)
    ship(df.sparkSession)
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        get, seen_before = m.index.get, {}
        for batch in slices(batches):
            texts = [words(t) for t in batch.column(at).to_pylist()]
            flat = list(chain.from_iterable(texts))
            sizes = np.array([len(x) for x in texts], dtype=np.int64)
            of = np.repeat(np.arange(len(texts)), sizes)
            place = np.fromiter(map(get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
            seen = np.flatnonzero(place >= 0)
            total = np.stack([np.bincount(of[seen], weights=m.rows[place[seen], j], minlength=len(texts)) for j in range(k)], axis=1).astype(float) if k and len(flat) else np.zeros((len(texts), k))
            rare: list[Counter] = [Counter() for _ in texts]
            for i in np.flatnonzero(place < 0):
                rare[of[i]][flat[i]] += 1
            if not joins:
                for i, c in enumerate(rare):
                    for w, n in c.items():
                        if w not in seen_before:
                            if len(seen_before) > HELD:
                                seen_before.clear()
                            seen_before[w] = m.backoff(w)
                        if seen_before[w] is not None:
                            total[i] += n * seen_before[w]
                    c.clear()
            left = np.array([sum(c.values()) for c in rare], dtype=np.int64)
            sure = np.full(len(texts), -1)
            if k:
                best = total.argmax(1)
                margin = total[np.arange(len(texts)), best][:, None] - total - left[:, None] * m.swing.T[best]
                margin[np.arange(len(texts)), best] = np.inf
                sure = np.where((left == 0) | (margin > 1e-6 * (1 + np.abs(total))).all(1), best, -1)
            letters = [any(any(map(str.isalpha, w)) for w in x) for x in texts]
            found = {"n": sizes, "letters": letters, "known": list(total), "rare": [list(c) for c in rare], "times": [list(c.values()) for c in rare], "sure": sure}
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(found[f.name], f.type) for f in out)], names=[*(batch.schema.names[i] for i in keep), *out.names])

    return df.mapInArrow(releasing(run), StructType([*own.fields, *schema.fields]))


TALLY = "n long, letters boolean, known array<double>, rare array<string>, times array<int>, sure int"


def totals_of(texts: DataFrame, model: Model) -> DataFrame:
    """(row, total): sums by language of all words of texts (row, known, rare, times), a table that is read twice."""
    spark, k = texts.sparkSession, len(model.langs)
    shared = spark.sparkContext.broadcast(model.table())
    rare = texts.selectExpr("row", "inline(arrays_zip(rare, times))")
    uses = rare.groupBy(F.col("rare").alias("word")).agg(F.count("*").alias("uses")).join(model.rest, "word", "left")

    def weigh(batches) -> Iterator[dict]:
        m = shared.value
        for batch in batches:
            counts = batch.column(2).to_pylist()
            yield {"word": batch.column(0), "uses": batch.column(1), "weights": [m.backoff(w) if c is None else np.log((np.array(c) + 0.5) / (m.totals[0] + 1)) for w, c in zip(batch.column(0).to_pylist(), counts, strict=True)]}

    weights = written(map_arrow(uses, "word string, uses long, weights array<double>", weigh), "langid-rare")
    hot_rows = max(graph.HOT_ROWS, (weights.agg(F.sum("uses")).first()[0] or 0) // graph.HOT_KEYS)
    hot = weights.where(F.col("uses") > hot_rows).select(F.col("word").alias("hot"), F.ceil(F.col("uses") / hot_rows).cast("int").alias("parts"))
    met = graph.looked_up(rare, "rare", "row", weights.where("weights IS NOT NULL").drop("uses"), "word", hot)
    more = met.groupBy(F.col("row").alias("of")).agg(F.array(*[F.sum(F.col("times") * F.get("weights", F.lit(j))) for j in range(k)]).alias("more"))
    total = F.when(F.col("more").isNull(), F.col("known")).otherwise(F.zip_with("known", "more", lambda x, y: x + y))
    return texts.select("row", "known").join(more, F.col("row") == F.col("of"), "left").select("row", total.alias("total"))


def named(langs: list[str], total: str) -> Column:
    """The language whose sum is greatest, the first of equals."""
    return F.get(F.array(*map(F.lit, langs)), F.array_position(total, F.array_max(total)).cast("int") - 1)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score of every whole text, one row for each row of df; only text is an input.

    Words of the learning rows score by their log frequency in each language; an unseen word by the mean over its n-grams of the
    greatest length at which half of them are known. score is the winner's share of the tempered posterior, 0 to 1.
    Null or letterless text, and any text under a model that learned nothing: `und`, 0. A text of which nothing is known: the first language, 1 / languages. Ties go to the language first
    in the alphabet. A null id stays null; repeated rows each give a row; further columns aren't read.
    A word that is hot among the words to be joined is split.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    texts = tallied(rows, "text", model, False)
    if not model.langs:
        return texts.select(F.col("id").alias(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model.rest is not None:
        texts = written(texts, "langid-texts")
        texts = texts.select("row", "id", "n", "letters").join(totals_of(texts, model), "row")
    else:
        texts = texts.withColumnRenamed("known", "total")
    mass = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max("total")) / F.sqrt("n")))
    return texts.select(F.col("id").alias(id_col), F.when(F.col("letters"), named(model.langs, "total")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letters"), 1 / mass).otherwise(0.0).alias("score"))


def label(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df, whole, whose text has a language (any but `und`), lang_col being what predict() says; without such a column df's columns stay as they are. Repeated rows stay.

    Texts aren't shuffled: the table alone decides nearly all languages beyond what rare words could change, and only the others' words are joined.
    """
    if not model.langs:
        return df.limit(0)
    row = unused(df, "_row_number")
    names = dict(zip(("n", "letters", "known", "rare", "times", "sure"), (unused(df, f"_langid_{c}") for c in ("n", "letters", "known", "rare", "times", "sure")), strict=True))
    with scratch(df.sparkSession) as keep:
        plain = df.withColumn(row, F.monotonically_increasing_id())
        table = tallied(plain.toDF(*[f"c{i}" for i in range(len(plain.columns))]), f"c{plain.columns.index(text_col)}", model, True)
        table = keep(written(table.toDF(*plain.columns, *names.values()).where(F.col(names["letters"])), "langid-labelled"))
        sure, key, pred = F.col(names["sure"]), unused(table, "_row_found"), unused(table, "_lang_pred")
        langs = F.array(*map(F.lit, model.langs))
        out = table.where(sure >= 0).withColumn(pred, F.get(langs, sure))
        if model.rest is not None:
            open_ = table.where(sure < 0)
            found = totals_of(open_.select(F.col(row).alias("row"), *[F.col(names[c]).alias(c) for c in ("known", "rare", "times")]), model)
            found = keep(written(found.select(F.col("row").alias(key), named(model.langs, "total").alias(pred)), "langid-open"))
            out = out.unionByName(open_.join(found, F.col(row) == F.col(key)).drop(key))
    return out.select(*[F.col(pred).cast(df.schema[c].dataType).alias(c) if c == lang_col else F.col(c) for c in df.columns])
