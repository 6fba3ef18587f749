"""Exact top-k inner products by tiled matrix products (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermal_lake.llm.common import map_arrow, ship

#: Candidates, and queries, that one product takes.
TILE, QUERY_TILE = 2048, 1024
#: Bytes of query vectors that are broadcast, or make a block; and bytes that a block of candidates has.
QUERY_BYTES, CANDIDATE_BYTES = 32 << 20, 64 << 20
EXACT = 2**53


def proper(vector: Column) -> Column:
    """Whether a vector has a place in the search: not null, not empty, every component finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(proper(F.col("v"))).withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**54, F.floor(x * 256).cast("double")).otherwise(x * 256)))


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by doubles where these are exact, else by Python's integers, held to 63 bits and a sign."""
    most = lambda x: float(np.abs(x).max(initial=0))
    if most(queries) * most(tile) * queries.shape[1] < EXACT:
        return (queries @ tile.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in r] for r in x], dtype=object)
    return np.clip(whole(queries) @ whole(tile).T, -(2**63 - 1), 2**63 - 1).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best by score, then the smaller id; ids has the scores' shape."""
    order = np.lexsort((ids, -scores.astype(np.float64) if np.abs(scores).max(initial=0) < EXACT else ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def partial(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """select() after a partition that keeps all that reach the k-th score; ids ascend and are one row."""
    if scores.shape[1] <= k:
        return select(scores, np.broadcast_to(ids, scores.shape), k)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    # the k first of those above the k-th score, then of those that tie with it, from the smallest id on
    above = scores > least
    tie = (scores == least) & (np.cumsum(scores == least, axis=1) <= k - above.sum(1, keepdims=True))
    at = np.nonzero(above | tie)[1].reshape(len(scores), k)
    return select(np.take_along_axis(scores, at, 1), ids[at], k)


NONE = -(2**63)


class Lists:
    """The best k candidates so far of every query of one length."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.scores, self.found = np.empty((len(ids), 0), dtype=np.int64), np.empty((len(ids), 0), dtype=np.int64)
        self.valid = np.empty((len(ids), 0), dtype=bool)

    def add(self, ids: np.ndarray, tile: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, starts = np.unique(ids[order], return_index=True)
        tile = tile[order]
        got = [self.block(s, ids, starts, tile) for s in range(0, len(self.ids), QUERY_TILE)]
        scores, found = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        # an id that earlier tiles had too keeps its better score alone
        for c in range(self.found.shape[1]):
            row, at = np.nonzero((found == self.found[:, c, None]) & (scores != NONE))
            held, more = self.scores[row, c], scores[row, at]
            self.scores[row, c] = np.maximum(held, more)
            scores[row, at] = NONE
        self.scores, self.found = select(np.concatenate((self.scores, scores), 1), np.concatenate((self.found, found), 1), 2 * self.k)

    def block(self, start: int, ids: np.ndarray, starts: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of a tile, whose rows of ids[i] begin at starts[i]; of rows that repeat an id the best counts."""
        scores = products(self.matrix[start : start + QUERY_TILE], tile)
        if len(starts) < len(tile):
            scores = np.maximum.reduceat(scores, starts, axis=1)
        scores[self.ids[start : start + QUERY_TILE, None] == ids] = NONE
        return partial(scores, ids, self.k)


def arrays(ids: pa.ChunkedArray | pa.Array, vs: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix of the vectors of each length."""
    ids, sizes, flat = ids.to_numpy(), np.diff(vs.offsets.to_numpy()[: len(vs) + 1]), vs.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = {}
    for d in map(int, np.unique(sizes)):
        at = np.flatnonzero(sizes == d)
        out[d] = ids[at], flat[starts[at, None] + np.arange(d)]
    return out


def lists_of(queries: pa.Table, k: int) -> dict[int, Lists]:
    return {d: Lists(ids, matrix, k) for d, (ids, matrix) in arrays(queries.column("id"), queries.column("v").combine_chunks()).items()} if queries.num_rows else {}


def results(lists: dict[int, Lists]) -> Iterator[dict]:
    for x in lists.values():
        q, c = np.nonzero(x.scores != NONE)
        yield {"query_id": x.ids[q], "vec_id": x.found[q, c], "score": x.scores[q, c]}


FOUND = "query_id long, vec_id long, score long"


def by_broadcast(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Each task's best candidates for all queries."""
    shared = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

    def kernel(batches) -> Iterator[dict]:
        lists = lists_of(shared.value, k)
        held: dict[int, list] = {}

        def flush(d: int) -> None:
            lists[d].add(np.concatenate([i for i, _ in held[d]]), np.concatenate([v for _, v in held[d]]))
            held[d] = []

        for batch in batches:
            for d, tile in (arrays(batch.column(0), batch.column(1)) if batch.num_rows else {}).items():
                if d in lists:
                    held.setdefault(d, []).append(tile)
                    if sum(len(i) for i, _ in held[d]) >= TILE:
                        flush(d)
        for d in held:
            if held[d]:
                flush(d)
        yield from results(lists)

    return map_arrow(rows, FOUND, kernel)


def by_tiles(asked: DataFrame, rows: DataFrame, k: int, size: int) -> DataFrame:
    """The best candidates of every block of candidates for every block of queries; a task holds one of each. Repeated rows count once, and rows of one id are dealt by their vectors."""
    ship(asked.sparkSession)
    rows = rows.distinct()
    wide = rows.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0
    q_blocks, c_blocks = -(-size * 8 // QUERY_BYTES), max(1, -(-wide * 8 // CANDIDATE_BYTES))
    q = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = rows.withColumn("c", F.pmod(F.xxhash64("id", "v"), F.lit(c_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = lists_of(left, k)
        for d, (ids, matrix) in (arrays(right.column("id"), right.column("v").combine_chunks()) if right.num_rows else {}).items():
            for s in range(0, len(ids) if d in lists else 0, TILE):
                lists[d].add(ids[s : s + TILE], matrix[s : s + TILE])
        parts = list(results(lists)) or [{"query_id": [], "vec_id": [], "score": []}]
        return pa.table({n: pa.array(np.concatenate([p[n] for p in parts]).astype(np.int64)) for n in ("query_id", "vec_id", "score")})

    return q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInArrow(meet, FOUND)


def search(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by the inner product of floor(256 x), ties to the smaller id.

    Rows where `queries` holds are asked against all rows with another id. Vectors that are null or empty, or hold a null or non-finite component,
    and rows with a null id take no part; a query meets candidates of its own length alone. An id that several rows repeat is
    one query (its first row in the order of the vectors) and, among one query's results, counts once with its best score. With fewer
    candidates than k all return. Products are exact; what exceeds 2^63 - 1 either way is held to that. Up to QUERY_BYTES of
    queries (counted) are broadcast and candidates aren't shuffled; beyond that blocks of queries meet blocks of candidates in tasks of their own, and nothing passes through the
    driver. Tasks keep 2 k candidates a query, and lists merge in two levels.
    """
    asked = vectors(df.where(queries), id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    rows = vectors(df, id_col, vector_col)
    size = asked.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0
    found = by_broadcast(asked, rows, k) if size * 8 <= QUERY_BYTES else by_tiles(asked, rows, k, size)
    best = lambda x, *by: x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")))
    found = found.withColumn("part", F.spark_partition_id() % 64).groupBy("query_id", "part", "vec_id").agg(F.max("score").alias("score"))
    found = best(found, "part").where(F.col("rank") <= k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(found).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
