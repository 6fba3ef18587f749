"""Connected components and allocation."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thermal_lake.shipping import ship

#: Rows of one key from which it is hot, at least; and the share of all rows that makes a key hot, as 1 / HOT_KEYS: no more keys than that can be.
HOT_ROWS, HOT_KEYS = 512, 4096
#: Nodes that a task connects at once; what it has found so far is handed on then.
HELD = 500_000
#: Edges left after that, counted, which one task connects whole; more take rounds.
ONE_TASK = 200_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the context's checkpoint folder or, on a local master alone (tests), a temporary folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="thermal-lake-")
            atexit.register(shutil.rmtree, own, True)
            sc.setCheckpointDir(own)
        root = sc._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


class Scratch(threading.local):
    """The tables that are being written inside scratch(), innermost scope last."""

    def __init__(self):
        self.scopes: list[list[str]] = []


_SCRATCH = Scratch()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those given to the function that this yields; those belong to the scope around, if there is one."""
    _SCRATCH.scopes.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._saved_at)
        return df

    try:
        yield keep
    finally:
        for path in _SCRATCH.scopes.pop():
            if path not in kept:
                discard(spark, path)
            elif _SCRATCH.scopes:
                _SCRATCH.scopes[-1].append(path)


def save(df: DataFrame, name: str) -> str:
    """Writes df as a table in the shared folder; its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    if _SCRATCH.scopes:
        _SCRATCH.scopes[-1].append(path)
    df.write.parquet(path)
    return path


def saved(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table that save() wrote."""
    df = spark.read.schema(schema).parquet(path)
    df._saved_at = path
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that the plan stays short and lost executors cost one step."""
    return saved(df.sparkSession, save(df, name), df.schema)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that save() wrote and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(hot, parts) for the keys that many of the rows have, HOT_KEYS at most; parts is how many pieces their rows are split into."""
    least = max(HOT_ROWS, total // HOT_KEYS)
    return rows.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("hot", F.ceil(F.col("n") / least).cast("int").alias("parts"))


def looked_up(rows: DataFrame, key: str, spread: str, table: DataFrame, table_key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with table, whose table_key is unique, on key. Hot keys' rows are split by the hash of `spread`, and their row of table goes to each piece; None: no key is hot."""
    if hot is None:
        return rows.join(table, F.col(key) == F.col(table_key), how)
    split = rows.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left").withColumn("_piece", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("parts"))).cast("int")).drop("hot", "parts")
    spare = table.join(F.broadcast(hot), F.col(table_key) == F.col("hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("hot", "parts")
    return split.join(spare, (F.col(key) == F.col(table_key)) & (F.col("_piece") == F.col("_part")), how).drop("_piece", "_part")


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes as these, one for each node of a task's part at most: from a node to the least one that the part connects it to. A node on its own keeps its loop."""
    ship(edges.sparkSession)
    schema = edges.select("a", "b").schema
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def found() -> Iterator[pa.RecordBatch]:
            large = {find(x) for x in parent if find(x) != x}
            rows = [(x, find(x)) for x in parent if x not in large]
            for s in range(0, len(rows), 65_536):
                part = rows[s : s + 65_536]
                yield pa.record_batch([pa.array([x for x, _ in part], out[0].type), pa.array([y for _, y in part], out[1].type)], schema=out)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
                if x < y:
                    parent[y] = x
                elif y < x:
                    parent[x] = y
            if len(parent) > HELD:
                yield from found()
                parent.clear()
        yield from found()

    return edges.select("a", "b").mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of edges (a, b), root the least node that is reachable.

    Tasks connect their own parts first, so that few edges are left; up to ONE_TASK of them a single task connects. Else each round a node takes the least root around it, and what its root's members found or its root itself points to; chains shorten by half
    or more a round. A round reads the table that the one before it wrote, which is deleted afterwards. Roots of many nodes, and nodes of many edges, are split.
    """
    spark = edges.sparkSession
    few_at = save(thinned(edges), f"{name}-thinned")
    few = spark.read.schema(edges.select("a", "b").schema).parquet(few_at)
    if few.count() <= ONE_TASK:
        star = thinned(few.coalesce(1))
        labels = written(star.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root"))))).distinct(), name)
        discard(spark, few_at)
        return labels
    around = save(few.unionAll(few.selectExpr("b AS a", "a AS b")).distinct(), f"{name}-edges")
    discard(spark, few_at)
    both = spark.read.parquet(around)
    total = both.count()
    hubs_at = save(hot_keys(both, "b", total), f"{name}-hubs")
    kind = both.schema["a"].dataType.simpleString()
    hubs = spark.read.schema(f"hot {kind}, parts int").parquet(hubs_at)
    hubs = None if hubs.isEmpty() else hubs
    at = save(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS root"), f"{name}-0")
    for turn in range(1, 10_000):
        labels = spark.read.schema(f"node {kind}, root {kind}").parquet(at)
        seen = looked_up(both, "b", "a", labels, "node", hubs).groupBy(F.col("a").alias("of")).agg(F.min("root").alias("seen"))
        step = labels.join(seen, F.col("node") == F.col("of"), "left").selectExpr("node", "root AS old", "least(root, seen) AS found")
        above = labels.selectExpr("node AS top", "root AS above")
        pulled = step.groupBy(F.col("old").alias("was")).agg(F.min("found").alias("found_by_any")).join(above, F.col("was") == F.col("top")).selectExpr("was", "least(found_by_any, above) AS to")
        step = looked_up(step, "old", "node", pulled, "was", hot_keys(labels, "root", total)).selectExpr("node", "old", "least(found, to) AS root")
        new = save(step, f"{name}-{turn}")
        discard(spark, at)
        at = new
        if spark.read.schema(f"node {kind}, old {kind}, root {kind}").parquet(at).where("root <> old").isEmpty():
            break
    for path in (around, hubs_at):
        discard(spark, path)
    return saved(spark, at, f"node {kind}, root {kind}")


def by_shared_keys(cases: DataFrame, case: str, keys: list[str], name: str = "key-components") -> DataFrame:
    """(case, root) of cases that share any key, directly or through others: star edges from each key's least case, no pairs. A null key links nothing."""
    parts = None
    for k in keys:
        part = cases.where(F.col(k).isNotNull()).select(F.lit(k).alias("axis"), F.col(k).cast("string").alias("key"), F.col(case).alias("a"))
        parts = part if parts is None else parts.unionAll(part)
    least = parts.groupBy("axis", "key").agg(F.min("a").alias("b"))
    found = components(parts.join(least, ["axis", "key"]).select("a", "b"), name)
    return cases.select(F.col(case)).distinct().join(found, F.col(case) == F.col("node"), "left").select(case, F.coalesce("root", case).alias("root"))


#: The splits in order, and their shares.
SPLITS = {"development": 0.6, "test": 0.2, "stress": 0.2}


def allocate(members: DataFrame, case: str, splits: dict[str, float] | None = None) -> DataFrame:
    """(case, split): whole components go to splits, the first ones to one each, then each to the split least filled for its share.

    Components stand by size, largest first, then by the SHA-256 of their case ids joined by NUL. The fold is over components (thousands), on one row;
    fewer components than splits raise.
    """
    shares = splits or SPLITS
    comps = members.groupBy("root").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(case).cast("string"))), "\0"), 256).alias("h"))
    rows = sorted(comps.collect(), key=lambda r: (-r["n"], r["h"]))
    if len(rows) < len(shares):
        raise ValueError(f"{len(rows)} independent components can't fill {len(shares)} splits")
    names, filled, out = list(shares), dict.fromkeys(shares, 0), []
    for i, row in enumerate(rows):
        split = names[i] if i < len(names) else min(names, key=lambda s: (filled[s] / shares[s], names.index(s)))
        filled[split] += row["n"]
        out.append((row["root"], split))
    kind = members.schema["root"].dataType.simpleString()
    plan = members.sparkSession.createDataFrame(out, f"root {kind}, split string")
    return members.join(plan, "root").select(case, "split")
