"""N-gram Jaccard join by a MinHash LSH forest (operator 10).

1. Texts with the same shingle set are one representative (a grouped minimum; copies are never paired).
2. A representative has a label of DEPTH minimum hashes in each of TREES trees. A tree is the sorted list of its labels: neighbours in it and how many hashes their
   labels begin with alike say all nodes of the prefix trie, at every depth. A range partitioning deals the list, so no node has to fit one task.
3. The prefix that has to match begins at DEPTH and is shortened until the recall that is measured on all neighbours, each verified, reaches the target in every
   range of similarities, at the latest where pairs at the threshold meet with that probability. Neighbours that share it are linked.
4. Components that fit a task are verified whole, every pair: at the shortest prefix, along with their neighbours; what is left of larger ones at the measured prefix, too. Those that are larger even then begin with their similar neighbours; then, node by node
   of the tries, the pairs whose ends are in different classes so far; at last every pair within a class, for the number of links. A node or class beyond a task meets in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermal_lake.llm.common import is_small, map_arrow, numbered, only_rows, scratch, without, written
from thermal_lake.operators import graph
from thermal_lake.operators.graph import components, hot_keys, looked_up

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 20, 8
#: Shingles, and representatives, that a block may hold on average.
BLOCK_SHINGLES, BLOCK_ROWS = 500_000, 1024
#: Representatives that are broadcast to their shingle sets, at most.
WITH_SETS = 200_000
#: The width of the ranges of similarities that the recall is measured in, and the steps of 1 in which neighbours' similarities are counted for that.
RANGE, STEPS = 0.05, 10_000
#: Bytes of a label that each of its hashes takes.
WIDE = 2
SEED = 20_011


def met(similarity: float, trees: int, length: int) -> float:
    """The probability that a pair of that similarity shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def longest_prefix(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix, from depth on, at which a pair at the threshold meets with that recall: the prefix is never shortened beyond it."""
    return next((n for n in range(depth, 1, -1) if met(threshold, trees, n) >= recall), 1)


def measured_recall(similarity: np.ndarray, depth: np.ndarray, length: int, trees: int, least: int, pairs: np.ndarray | None = None) -> float:
    """Of the similar pairs that there must be, the part that prefixes of that length find, in the range of similarities where it is least.

    similarity and depth (the longest prefix shared) are of pairs that met at length `least`, pairs says of how many (None: one each); each stands for 1 / met() pairs, so that those which didn't meet count too. Without any pair: 0.
    """
    if not len(similarity):
        return 0.0
    pairs = np.ones(len(similarity)) if pairs is None else pairs
    bins = np.floor(similarity / RANGE + 1e-9).astype(int)
    total = np.bincount(bins, weights=pairs / np.array([met(x, trees, least) for x in similarity]))
    found = np.bincount(bins, weights=pairs * (depth >= length), minlength=len(total))
    return float((found[total > 0] / total[total > 0]).min())


def shortened(similarity: np.ndarray, depth: np.ndarray, trees: int, deepest: int, least: int, recall: float, pairs: np.ndarray | None = None) -> int:
    """The prefix, shortened from the deepest on until its measured recall reaches the target; `least` if none does."""
    return next((n for n in range(deepest, least, -1) if measured_recall(similarity, depth, n, trees, least, pairs) >= recall), least)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct word shingles of a text; texts with fewer words have one shingle of them all."""

    def __init__(self, words: int = WORDS, remembered: int = 100_000):
        self.words, self.remembered, self.known = words, remembered, {}

    def hash(self, word: str) -> int:
        if len(self.known) >= self.remembered:
            self.known.clear()
        self.known[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        found = text.lower().split() if text else []
        if not found:
            return np.empty(0, dtype=np.uint64)
        get = self.known.get
        h = np.array([get(w) or self.hash(w) for w in found], dtype=np.uint64)
        k = min(self.words, len(h))
        total = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            total = mixed(total + h[i : len(h) - k + 1 + i] + np.uint64(i + 1))
        return np.unique(total)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least product with each seed; in parts, so that a very long text stays bounded. Shingles are hashes already."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[start : start + 2048] * seeds[:, None]).min(1), out=least)
    return least


def labels(shingles: np.ndarray, seeds: np.ndarray) -> bytes:
    """The labels of all trees, one after the other: WIDE bytes for each minimum hash."""
    return mixed(signature(shingles, seeds)).astype("<u2").tobytes()


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def seeds_of(trees: int, depth: int) -> np.ndarray:
    """Odd multipliers, depth for each tree."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(1, 2**63, size=trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes the labels in the rows of a and of b begin with alike."""
    return np.cumprod((a == b).reshape(len(a), -1, WIDE).all(2), axis=1).sum(1)


def neighbours(reps: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(a, b, depth): representatives that stand side by side in some tree's sorted labels, and the longest prefix of `least` hashes or more that they share there.

    Links of neighbours whose prefix is n long or more connect just the representatives that share a node at depth n.
    """
    spark, size = reps.sparkSession, depth * WIDE
    label = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("labels"), t * size + 1, F.lit(size)))
    tries = reps.select("rep", F.posexplode(label).alias("tree", "label")).repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")

    def walk(batches) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rep, tree = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fixed = batch.column(2).cast(pa.binary(size))
            label = np.frombuffer(fixed.buffers()[1], dtype=np.uint8)[fixed.offset * size : (fixed.offset + n) * size].reshape(n, size)
            if last is None:
                yield {"a": [int(rep[0])], "b": [None], "depth": [0], "part": [part], "tree": [int(tree[0])], "label": [label[0].tobytes()]}
            else:
                rep, tree, label = np.concatenate((last[0], rep)), np.concatenate((last[1], tree)), np.concatenate((last[2], label))
            alike = common_prefix(label[:-1], label[1:])
            at = np.flatnonzero((tree[1:] == tree[:-1]) & (alike >= least))
            none = [None] * len(at)
            yield {"a": np.minimum(rep[at], rep[at + 1]), "b": np.maximum(rep[at], rep[at + 1]), "depth": alike[at], "part": none, "tree": none, "label": none}
            last = rep[-1:].copy(), tree[-1:].copy(), label[-1:].copy()
        if last is not None:
            yield {"a": [int(last[0][0])], "b": [None], "depth": [1], "part": [part], "tree": [int(last[1][0])], "label": [last[2][0].tobytes()]}

    walked = written(map_arrow(tries, "a long, b long, depth int, part int, tree int, label binary", walk, rows=1 << 16), "jaccard-tries")
    # each task's first and last label, two rows a task: where one task's list ends and the next one's goes on
    ends = sorted((r["part"], r["depth"], r["tree"], bytes(r["label"]), r["a"]) for r in walked.where("b is null").collect())
    between = []
    for x, y in zip(ends, ends[1:], strict=False):
        if x[0] != y[0] and x[2] == y[2]:
            n = int(common_prefix(*(np.frombuffer(e[3], dtype=np.uint8)[None] for e in (x, y)))[0])
            if n >= least:
                between.append((min(x[4], y[4]), max(x[4], y[4]), n))
    edges = walked.where("b is not null").select("a", "b", "depth").unionAll(spark.createDataFrame(between, "a long, b long, depth int"))
    return written(edges.groupBy("a", "b").agg(F.max("depth").alias("depth")), "jaccard-neighbours")


def intersections(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of rows shares with each of columns, by products of 0/1 matrices over slices of the shingles that at least two have."""
    sizes = [len(x) for x in (*rows, *columns)]
    value, at, n = np.unique(np.concatenate((*rows, *columns)), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = n > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    at, owner = place[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    width = max(256, (4 << 20) // len(sizes))
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(at, (start, start + width))
        x = np.zeros((len(sizes), width), dtype=np.float32)
        x[owner[lo:hi], at[lo:hi] - start] = 1
        out += x[: len(rows)] @ x[len(rows) :].T
    return out


def linked(rows: list[np.ndarray], columns: list[np.ndarray], threshold: float, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted pairs of rows x columns have that Jaccard similarity (sizes rule some out beforehand)."""
    a, b = np.array([len(x) for x in rows]), np.array([len(x) for x in columns])
    wanted = wanted & (np.minimum(a[:, None], b) >= threshold * np.maximum(a[:, None], b) - 1e-9)
    out = np.zeros_like(wanted)
    n = int(wanted.sum())
    if not n:
        return out
    if n <= 2 * (len(rows) + len(columns)):
        i, j = np.nonzero(wanted)
        both = np.array([len(np.intersect1d(rows[x], columns[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
        good = both >= threshold * (a[i] + b[j] - both) - 1e-6
        out[i[good], j[good]] = True
    else:
        used, other = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        both = intersections([rows[x] for x in used], [columns[y] for y in other])
        for s in range(0, len(used), 256):  # a few rows at a time, so that temporary arrays stay small
            at = used[s : s + 256]
            part = both[s : s + 256]
            out[np.ix_(at, other)] = wanted[np.ix_(at, other)] & (part >= threshold * (a[at, None] + b[other] - part) - 1e-6)
    return out


def merged(link: np.ndarray, shift: int, n: int) -> np.ndarray:
    """The least member of each of n members' group, where link holds between row i and column j + shift."""
    group = np.arange(n)
    for i in np.flatnonzero(link.any(1)):
        near = np.unique(np.append(group[np.flatnonzero(link[i]) + shift], group[i]))
        if len(near) > 1:
            group[np.isin(group, near)] = near[0]
    return group


def blocks(size: Column, count: Column) -> Column:
    return F.ceil(F.greatest(size / BLOCK_SHINGLES, count / BLOCK_ROWS)).cast("int")


def blocks_of(rows: DataFrame, group: str) -> DataFrame:
    """(of, lead, lead_blocks, other_blocks) for the groups that need more than one block; nothing leads them."""
    found = rows.groupBy(F.col(group).alias("of")).agg(blocks(F.sum("size"), F.count("*")).alias("other_blocks")).where("other_blocks > 1")
    return found.select("of", F.lit(None).cast("long").alias("lead"), F.lit(0).alias("lead_blocks"), "other_blocks")


def mixed_groups(rows: DataFrame, group: str) -> DataFrame:
    """The same for the groups with more than one class: the largest class leads, in blocks of its own that needn't meet each other."""
    per = rows.groupBy(F.col(group).alias("of"), "cls").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = per.groupBy("of").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "cls", "size")).alias("top")).where("classes > 1")
    return top.select("of", F.col("top.cls").alias("lead"), blocks(F.col("top.size"), F.col("top.n")).alias("lead_blocks"), blocks(F.col("size") - F.col("top.size"), F.col("n") - F.col("top.n")).alias("other_blocks"))


def verified(rows: DataFrame, sets: DataFrame, group: str, threshold: float, layout: DataFrame | None = None) -> DataFrame:
    """(rep, links, root) for the members of groups in rows (group, rep, copies, cls): every pair of a group is verified, but for those of one class (null: none).

    Groups meet in the blocks of their layout (see blocks_of; one block without it); each block with each other one is a task's, unless both are of the class that leads. A row holds the copies that a task links rep to, and the least
    member of what it connects rep to; a rep has a row for each task.
    """
    if layout is None:
        dealt = rows.withColumns({"block": F.lit(0), "other": F.lit(0)})
    else:
        dealt = looked_up(rows, group, "rep", layout, "of", hot_keys(rows, group, rows.count()), "left").withColumns({"others": F.coalesce("other_blocks", F.lit(1)), "leads": F.coalesce(F.col("cls") == F.col("lead"), F.lit(False)), "led": F.coalesce("lead_blocks", F.lit(0))})
        at = F.pmod(F.xxhash64("rep"), F.when(F.col("leads"), F.col("led")).otherwise(F.col("others"))).cast("int")
        dealt = dealt.withColumn("block", at + F.when(F.col("leads"), F.col("others")).otherwise(0))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(F.col("leads"), 0).otherwise(F.col("led")) - 1)))
    dealt = dealt.select(F.col(group).alias("grp"), F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "rep", "copies", "cls")
    dealt = dealt.join(sets, "rep")

    def verify(table: pa.Table) -> pa.Table:
        t = table.sort_by("rep")
        first, second = t.column("first")[0].as_py(), t.column("second")[0].as_py()
        names, copies, block = (t.column(c).to_numpy() for c in ("rep", "copies", "block"))
        of = np.array([-1 - i if x is None else x for i, x in enumerate(t.column("cls").to_pylist())], dtype=np.int64)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        wanted = of[a, None] != of[b]
        if first == second:
            link = linked([sets[i] for i in a], [sets[i] for i in b], threshold, np.triu(wanted, 1))
            counts, order, group = copies[a] @ (link | link.T), a, merged(link, 0, len(a))
        else:
            link = linked([sets[i] for i in a], [sets[i] for i in b], threshold, wanted)
            order, group = np.concatenate((a, b)), merged(link, len(a), len(a) + len(b))
            counts = np.concatenate((link @ copies[b], copies[a] @ link))
        some = np.flatnonzero(counts)
        return pa.table({"rep": pa.array(names[order[some]], pa.int64()), "links": pa.array(counts[some], pa.int64()), "root": pa.array(names[order[group[some]]], pa.int64())})

    return dealt.groupBy("grp", "first", "second").applyInArrow(verify, "rep long, links long, root long")


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with their exact similarity."""
    two = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b").select(*pairs.columns, "x", "y")
    names, n = pairs.columns, len(pairs.columns)

    def compare(batches) -> Iterator[dict]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
                out.append(both / ((len(x) + len(y)) // 8 - both))
            yield {c: batch.column(i) for i, c in enumerate(names)} | {"similarity": out}

    return map_arrow(two, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", similarity double", compare)


def whole_components(near: DataFrame, edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Components in near (rep, comp, copies) that fit a task, every pair verified: (rep, links, root) as verified() has them, and rows (similarity, depth, pairs) that count the edges (a, b, depth) inside.

    A set goes to its component once, and both are found there. Up to WITH_SETS representatives (counted) are broadcast to their sets, which then are shuffled once; more meet them by a shuffle.
    """
    beside = edges.groupBy(F.col("a").alias("of")).agg(F.collect_list(F.struct("b", "depth")).alias("beside"))
    dealt = written(near.join(beside, F.col("rep") == F.col("of"), "left").select("comp", "rep", "copies", "beside"), "jaccard-dealt")
    dealt = sets.join(F.broadcast(dealt) if is_small(dealt, WITH_SETS) else dealt, "rep")

    kind = "rep long, links long, root long, similarity double, depth int, pairs long"
    out = to_arrow_schema(StructType.fromDDL(kind))

    def verify(table: pa.Table) -> pa.Table:
        t = table.select(["rep", "copies", "beside", "shingles"]).sort_by("rep")
        names, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("shingles")]
        at = {r: i for i, r in enumerate(names.tolist())}
        tally: Counter = Counter()
        for x, near in zip(sets, t.column("beside").to_pylist(), strict=True):
            for e in near or ():
                y = sets[at[e["b"]]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                similarity = both / (len(x) + len(y) - both)
                if similarity >= threshold - 1e-9:
                    tally[math.floor(similarity * STEPS + 1e-6) / STEPS, e["depth"]] += 1
        link = linked(sets, sets, threshold, np.triu(np.ones((len(sets), len(sets)), dtype=bool), 1))
        counts, group = copies @ (link | link.T), merged(link, 0, len(sets))
        some = np.flatnonzero(counts)
        ours, theirs = [None] * len(some), [None] * len(tally)
        links = {"rep": names[some].tolist() + theirs, "links": counts[some].tolist() + theirs, "root": names[group[some]].tolist() + theirs}
        pairs = {"similarity": ours + [s for s, _ in tally], "depth": ours + [d for _, d in tally], "pairs": ours + [*tally.values()]}
        return pa.table(links | pairs, schema=out)

    return written(dealt.groupBy("comp").applyInArrow(verify, kind), "jaccard-whole")


def in_large(near: DataFrame, similar: DataFrame, reps: DataFrame, sets: DataFrame, length: int, trees: int, depth: int, threshold: float) -> DataFrame:
    """(rep, root, links) of the members `near` (rep, comp, copies, size) of components beyond a task; similar (a, b): neighbours that are linked for sure, inside components or across them."""
    inside = lambda e: near.select(F.col("rep").alias(e))
    sure = [written(similar.select("a", "b").join(inside("a"), "a", "left_semi").join(inside("b"), "b", "left_semi"), "jaccard-sure")]

    def classed() -> DataFrame:
        found = components(reduce(DataFrame.unionAll, sure), "jaccard-classes")
        return written(near.join(found, F.col("rep") == F.col("node"), "left").select("rep", "copies", "size", F.coalesce("root", "rep").alias("cls")), "jaccard-classed")

    # nodes of the tries that hold more than one class
    classes = classed()
    prefix = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.substring(F.col("labels"), t * depth * WIDE + 1, F.lit(length * WIDE))))
    nodes = classes.join(reps.select("rep", "labels"), "rep").select("rep", "copies", "size", "cls", F.explode(prefix).alias("at"))
    nodes = written(nodes, "jaccard-nodes")
    layout = written(mixed_groups(nodes, "at"), "jaccard-layout")
    nodes = written(looked_up(nodes, "at", "rep", layout.select("of"), "of", hot_keys(nodes, "at", nodes.count())).drop("of"), "jaccard-mixed")
    across = written(verified(nodes, sets, "at", threshold, layout).where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct(), "jaccard-across")
    if not across.isEmpty():
        sure.append(across)
        classes = classed()
    # the links of every pair in a class
    whole = classes.select("rep", "copies", "size", F.col("cls").alias("within"), F.lit(None).cast("long").alias("cls"))
    links = verified(whole, sets, "within", threshold, written(blocks_of(whole, "within"), "jaccard-blocks")).groupBy("rep").agg(F.sum("links").alias("links"))
    return classes.join(links, "rep", "left").select("rep", F.col("cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, row_col: str | None = None) -> DataFrame:
    """Classes of similar texts: one row for each row of df with the id, class_id, class_size, n_links and is_representative.

    Two rows are linked if the sets of their word shingles (lower-case words between white space) have a Jaccard similarity of
    threshold or more; a class is a connected component of links and class_id the least id in it. n_links is the
    number of other rows linked to a row, copies counted, though copies are never paired. Pairs at the threshold are found with probability
    recall, more similar ones more surely, pairs within a class always; what is found is verified exactly. is_representative holds for one row of each class: that of the
    least id (of repeated rows with this id, one). Null, empty and blank texts have no shingles: each is a class of its own without links,
    as is a row of a null id without links (a class with nothing but null ids has a null class_id). Shorter texts than `words` have one shingle. Further columns aren't read. df is read
    once: its rows are written with a number each, by which texts of candidates are found again. row_col names such a number of a written table, which then returns too.
    """
    with scratch(df.sparkSession) as keep:
        least = longest_prefix(trees, depth, threshold, recall)
        seeds = seeds_of(trees, depth)
        rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
        rows = (rows if row_col else numbered(rows, "row")).select("row", "id", "text")

        def sketch(batches) -> Iterator[dict]:
            shingler = Shingler(words)
            for batch in batches:
                sets = [shingler(t) for t in batch.column(2).to_pylist()]
                yield {"row": batch.column(0), "id": batch.column(1), "key": [set_key(x) if len(x) else None for x in sets], "size": [len(x) for x in sets], "labels": [labels(x, seeds) if len(x) else None for x in sets]}

        sketches = keep(written(map_arrow(rows, "row long, id long, key binary, size int, labels binary", sketch), "jaccard-sketches"))
        some = sketches.where("key is not null")
        head = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
        reps = some.groupBy("key").agg(F.min("row").alias("rep"), F.min("id").alias("id"), F.min(head).alias("head"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("labels").alias("labels"))
        reps = written(reps, "jaccard-representatives")
        edges = neighbours(reps, trees, depth, least)

        def shingle(batches) -> Iterator[dict]:
            shingler = Shingler(words)
            for batch in batches:
                yield {"rep": batch.column(0), "shingles": [shingler(t).tobytes() for t in batch.column(1).to_pylist()]}

        def sets_of(wanted: DataFrame, name: str) -> DataFrame:
            return written(map_arrow(only_rows(rows.select("row", "text"), "row", wanted, True), "rep long, shingles binary", shingle), name)

        def joined(edges: DataFrame, name: str) -> DataFrame:
            found = components(edges.select("a", "b"), name).join(reps, F.col("node") == F.col("rep"))
            return written(found.select("rep", F.col("root").alias("comp"), "copies", "size"), name)

        def parted(near: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame | None]:
            if large.isEmpty():
                return near, None
            return near.join(large, F.col("comp") == F.col("of"), "left_anti"), looked_up(near, "comp", "rep", large.select("of"), "of", hot_keys(near, "comp", near.count())).drop("of")

        # every neighbour is verified: they measure the recall, and the similar ones connect the large components; the others are done with then, at the shortest prefix
        near = joined(edges, "jaccard-beside")
        sets = sets_of(near.select(F.col("rep").alias("row")), "jaccard-sets")
        large = written(blocks_of(near, "comp"), "jaccard-large")
        small, inside = parted(near, large)
        whole = whole_components(small, edges, sets, threshold)
        found = whole.where("rep IS NOT NULL").select("rep", "root", "links")
        measured = whole.where("rep IS NULL").select("similarity", "depth", "pairs")
        if inside is not None:
            inside = written(inside, "jaccard-inside")
            # joins below shuffle sets, so that only these go there
            sets = written(only_rows(sets, "rep", inside.select("rep"), True), "jaccard-inside-sets")
            own = edges.join(inside.select(F.col("rep").alias("a")), "a", "left_semi").select("a", "b", "depth")
            similar = written(similar_pairs(own, sets).where(F.col("similarity") >= threshold - 1e-9), "jaccard-similar")
            measured = measured.unionAll(similar.groupBy((F.floor(F.col("similarity") * STEPS + 1e-6) / STEPS).alias("similarity"), "depth").agg(F.count("*").alias("pairs")))
        measured = measured.groupBy("similarity", "depth").agg(F.sum("pairs").alias("pairs")).toArrow()
        length = shortened(measured.column("similarity").to_numpy(), measured.column("depth").to_numpy(), trees, depth, least, recall, measured.column("pairs").to_numpy())
        if inside is not None and length > least:
            near = joined(own.where(F.col("depth") >= length), "jaccard-near")
            large = written(blocks_of(near, "comp"), "jaccard-large")
            small, inside = parted(near, large)
            found = found.unionAll(verified(small.withColumn("cls", F.lit(None).cast("long")), sets, "comp", threshold).select("rep", "root", "links"))
            inside = None if inside is None else written(inside, "jaccard-inside")
        if inside is not None:
            found = found.unionAll(in_large(inside, similar, reps, sets, length, trees, depth, threshold))

        members = reps.select("key", "rep", "id", "head", "copies").join(found, "rep", "left").select("key", "id", "head", "copies", "links", F.coalesce("root", "rep").alias("root"))
        members = written(members, "jaccard-found")
        heads = members.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("head").alias("head"))
        members = looked_up(members.drop("head"), "root", "key", heads.withColumnRenamed("root", "of"), "of", hot_keys(members, "root", members.count()))
        members = keep(written(members.select(F.col("key").alias("of"), "class_id", "class_size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("head.row").alias("head")), "jaccard-members"))
        many = max(graph.HOT_ROWS, sketches.count() // graph.HOT_KEYS)
        hot = reps.where(F.col("copies") > many).select(F.col("key").alias("hot"), F.ceil(F.col("copies") / many).cast("int").alias("parts"))
        hot = keep(written(hot, "jaccard-hot"))
        classed = looked_up(some.select("row", "id", "key"), "key", "row", members, "of", hot)
        alone = sketches.where("key is null").select("row", "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("is_representative"))
        every = classed.select("row", "id", "class_id", "class_size", "n_links", (F.col("row") == F.col("head")).alias("is_representative")).unionAll(alone)
        return every.select(*([F.col("row").alias(row_col)] if row_col else []), F.col("id").alias(id_col), "class_id", "class_size", "n_links", "is_representative")


def deduplicate(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df, whole, without those that join() says are not their class's representative."""
    return without(df, lambda rows, row: _rows(rows, id_col, text_col, row, options))


def _rows(rows: DataFrame, id_col: str, text_col: str, row: str, options: dict) -> DataFrame:
    found = join(rows.select(F.col(row), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", row_col=row, **options)
    return found.where(~F.col("is_representative")).select(row)
