"""Benchmark decontamination by spaced seeds (operator 4), in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermal_lake.llm.common import is_small, numbered, only_rows, without, written

#: Spaced seeds: 1 marks the words that a window's hash takes, 0 those that may differ. Slid over OVERLAP words, one of them
#: misses every set of substitutions that AGREE accepts (a test enumerates these sets).
MASKS = ("111011", "1100001011", "110111")
#: The same for items with fewer words, by their number.
SHORT_MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",),
    4: ("111", "1101", "1011"), 5: ("111", "1101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("11011", "1111", "1100011"),
    9: ("11101", "100111"), 10: ("11101", "1111"), 11: ("11101",), 12: ("11101", "10111"),
}
#: An overlap is verified if, of OVERLAP words in a row (of all, if an item has fewer), that share agree in place.
OVERLAP, AGREE = 13, 0.75
#: Items with fewer words are left out: those without any.
LEAST = 1
#: Windows, and words, of a benchmark up to which it is broadcast; beyond that its windows are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_WORDS = 500_000, 1_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of a text's lower-case words (letters and digits); of null, an empty array."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def window_hashes(words: Column, at: Column, masks: list[str]) -> Column:
    """The hashes of the windows at a place, one for each mask that fits there (null elsewhere)."""
    one = lambda k, m: F.when(at + len(m) <= F.size(words), F.xxhash64(F.lit(k), *[F.get(words, at + i) for i in offsets(m)]))
    return F.array(*[one(f"{m}", m) for m in masks])


def windows(df: DataFrame, words: str, masks: list[str], keep: list[str]) -> DataFrame:
    """keep, place and window for each window; one row for each mask and place."""
    least = min(map(len, masks))
    # a filter on the size would hash the words of each text twice; explode() makes no row of null
    at = df.select(*{*keep, words}, F.explode(F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least))).alias("place"))
    return at.select(*keep, "place", F.explode(window_hashes(F.col(words), F.col("place"), masks)).alias("window"))


def best_run(words: Column, item: Column, shift: Column) -> Column:
    """Of the item's words aligned with a text at shift: the struct (agree, start) of the run of OVERLAP words that agree best, the first of equals."""
    n = F.size(item)
    span = F.least(n, F.lit(OVERLAP))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.get(words, shift + i) == F.get(item, i), F.lit(1)).otherwise(F.lit(0)))
    sums = lambda same: F.transform(F.sequence(F.lit(0), n - span), lambda s: F.struct(F.aggregate(F.slice(same, s + 1, span), F.lit(0), lambda a, x: a + x).alias("agree"), (-s).alias("start")))
    return F.array_max(sums(same))


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS) -> DataFrame:
    """Overlaps of texts with benchmark items that tolerate substitutions: id, item id, agree, of, place, item_place, similarity.

    A window of a text and one of an item that agree in the words a mask takes are a hit. At each hit the two are aligned whole, and
    the overlap is verified if AGREE of OVERLAP words in a row (of all words, if the item has fewer) are the same. Of several
    overlaps of one text with one item the best returns (most words agree, then the first in the text): one row for each pair. Items of fewer than OVERLAP
    words are sought by the masks of their length, whole up to 3 words, where AGREE tolerates none; null and wordless items are left out, as are null and empty texts. Repeated
    rows of a text or an item count once by their id; rows with a null id are found like others and return a null id. Further columns aren't read. The
    benchmark's windows are counted, and broadcast up to BROADCAST_WINDOWS: then texts are neither shuffled nor collected. Beyond that windows are joined by a shuffle; df's
    ids and texts are then written with a number of each row, by which texts with a hit are found again.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), word_hashes(F.col(item_text_col)).alias("item_words")).where(F.size("item_words") >= LEAST)
    # the masks of each length of item, so that no overlap that would be verified goes without a hit
    length = F.size("item_words")
    short = [r[0] for r in items.where(length < OVERLAP).select(length.alias("n")).distinct().orderBy("n").collect()]
    every = list(dict.fromkeys([*masks, *(m for n in short for m in SHORT_MASKS[n])]))
    span = max(map(len, every))
    parts = [windows(items.where(length >= OVERLAP), "item_words", list(masks), ["item"])]
    parts += [windows(items.where(length == n), "item_words", list(SHORT_MASKS[n]), ["item"]) for n in short]
    seeds = parts[0]
    for p in parts[1:]:
        seeds = seeds.unionByName(p)
    seeds = seeds.where("window is not null").select(F.col("item"), F.col("place").alias("item_place"), "window").distinct()
    items = items.distinct().withColumnRenamed("item", "of_item")
    same_item = F.col("item").eqNullSafe(F.col("of_item"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = word_hashes(F.col("text")).alias("words")
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    if is_small(seeds, BROADCAST_WINDOWS) and (items.agg(F.sum(F.size("item_words"))).first()[0] or 0) <= BROADCAST_WORDS:
        hits = windows(texts.select("id", hashed), "words", every, ["id", "words"]).where("window is not null").join(F.broadcast(seeds), "window").join(F.broadcast(items), same_item)
        # of hits that follow each other on one alignment, the first is enough: skip one if the words of the window before it, of any mask, all agree
        run = F.lit(True)
        for i in range(span):
            run = run & F.coalesce(F.get("words", F.col("place") - 1 + i) == F.get("item_words", F.col("item_place") - 1 + i), F.lit(False))
        hits = hits.where(~run).select("id", "item", "words", "item_words", shift)
    else:
        # windows alone are shuffled; only texts with a hit come along afterwards
        texts = numbered(texts, "row").select("row", "id", hashed)
        narrow = windows(texts, "words", every, ["row"]).select("row", "place", "window").where("window is not null")
        found = written(narrow.join(seeds, "window").select("row", "item", shift).distinct(), "leak-hits")
        hits = found.join(only_rows(texts, "row", found, True), "row").join(items, same_item).select("id", "item", "words", "item_words", "shift")
    size = F.least(F.size("item_words"), F.lit(OVERLAP))
    checked = hits.select("id", "item", "shift", size.alias("of"), best_run(F.col("words"), F.col("item_words"), F.col("shift")).alias("run"))
    checked = checked.where(F.col("run.agree") >= F.ceil(F.col("of") * AGREE))
    best = checked.groupBy("id", "item").agg(F.max(F.struct(F.col("run.agree").alias("agree"), (F.col("run.start") - F.col("shift")).alias("minus_place"), F.col("run.start").alias("minus_item"), F.col("of"))).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.agree").cast("long").alias("agree"), F.col("b.of").cast("long").alias("overlap"), (-F.col("b.minus_place")).cast("long").alias("place"),
        (-F.col("b.minus_item")).cast("long").alias("item_place"), (F.col("b.agree") / F.col("b.of")).alias("similarity"),
    )


def drop_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of df, whole, without those that overlap with a benchmark item."""
    return without(df, lambda numbered, row: find_leaks(numbered.select(row, text_col), benchmark, row, text_col, **options))
