"""Evaluation: metrics by split and mode, bootstrap intervals, error tables, distributions."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermal_lake.functions.rounding import python_round
from thermal_lake.shipping import ship

LABELS = ("positive", "control")
MODES = ("one_shot", "fixed_bundle", "adaptive")


def ratio(a: Column, b: Column) -> Column:
    """a / b to six digits, 0 if b is 0."""
    return python_round(F.when(b == 0, 0.0).otherwise(a / b))


def confusion() -> list[Column]:
    """Counts for each label: true and false positives, false negatives."""
    p, y = F.col("prediction"), F.col("label")
    out = []
    for c in LABELS:
        says = F.coalesce(p == c, F.lit(False))
        out += [F.count_if((y == c) & says).alias(f"{c}_tp"), F.count_if((y != c) & says).alias(f"{c}_fp"), F.count_if((y == c) & ~says).alias(f"{c}_fn")]
    return out


def with_metrics(df: DataFrame) -> DataFrame:
    """Confusion counts to precision, recall and F1 of each label and their means; each is rounded before the next uses it."""
    for c in LABELS:
        tp, fp, fn = (F.col(f"{c}_{x}") for x in ("tp", "fp", "fn"))
        df = df.withColumns({f"{c}_precision": ratio(tp, tp + fp), f"{c}_recall": ratio(tp, tp + fn)})
        a, b = F.col(f"{c}_precision"), F.col(f"{c}_recall")
        df = df.withColumn(f"{c}_f1", ratio(2.0 * a * b, a + b))
    return df.withColumns({f"macro_{m}": python_round((F.col(f"positive_{m}") + F.col(f"control_{m}")) / 2) for m in ("f1", "precision", "recall")})


def by_split_and_mode(rows: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Aggregates for each split and mode and, in the same pass, for all splits together ("combined")."""
    g = rows.groupingSets([[F.col("split"), F.col("mode")], [F.col("mode")]], F.col("split"), F.col("mode")).agg(F.grouping("split").alias("_all"), *aggregates)
    return g.withColumn("split", F.when(F.col("_all") == 1, "combined").otherwise(F.col("split"))).drop("_all")


def tables(rows: DataFrame) -> DataFrame:
    """Case counts, metrics, abstentions, resolution of cases that one_shot leaves open, resources and errors by split and mode."""
    open_ = rows.where("mode = 'one_shot' AND prediction IS NULL").select("split", "case_id", F.lit(True).alias("_open"))
    r = rows.join(open_, ["split", "case_id"], "left")
    resources = [x for c in ("observation_count", "selected_source_bytes", "downloaded_bytes", "latency_milliseconds") for x in (F.sum(c).alias(c), python_round(F.avg(c)).alias(f"mean_{c}"))]
    opened = F.col("_open").isNotNull()
    out = by_split_and_mode(r, [
        F.count("*").alias("case_count"), *confusion(), F.count_if(F.col("prediction").isNull()).alias("abstention_count"), F.count_if(opened).alias("ambiguous_count"),
        F.count_if(opened & F.col("prediction").isNotNull()).alias("resolved_count"), *resources, F.count_if(F.col("error_count") > 0).alias("error_case_count"),
    ])
    return with_metrics(out).withColumns({"abstention_coverage": ratio(F.col("abstention_count"), F.col("case_count")), "resolution_rate": ratio(F.col("resolved_count"), F.col("ambiguous_count"))})


def hash_draws(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    """How often each row is drawn in each sample, without collecting a group: a row's count is a Poisson(1) draw from a hash of (seed, sample, case, mode), which for many rows is the bootstrap's multinomial."""
    s = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "sample", "mode", F.col("case_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    steps, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(12):
        total += p
        steps = steps + F.when(u >= total, 1).otherwise(0)
        p /= k + 1
    return s.withColumn("times", steps)


def weighted_confusion() -> list[Column]:
    p, y, n = F.col("prediction"), F.col("label"), F.col("times")
    out = []
    for c in LABELS:
        says = F.coalesce(p == c, F.lit(False))
        add = lambda ok: F.sum(F.when(ok, n).otherwise(0))
        out += [add((y == c) & says).alias(f"{c}_tp"), add((y != c) & says).alias(f"{c}_fp"), add((y == c) & ~says).alias(f"{c}_fn")]
    return out


def interval(values: Column) -> list[Column]:
    """Order statistics 2.5 % and 97.5 % of a small array: the lower index is cut, the upper one raised."""
    v, n = F.array_sort(values), F.size(values)
    return [F.get(v, F.floor(0.025 * (n - 1)).cast("int")).alias("lower"), F.get(v, F.ceil(0.975 * (n - 1)).cast("int")).alias("upper")]


def bootstrap(rows: DataFrame, samples: int = 200, seed: int = 20260101) -> DataFrame:
    """mode, lower and upper of the macro F1 by hashed draws: partial sums for each sample, then one small array for each mode."""
    by = with_metrics(hash_draws(rows, samples, seed).groupBy("mode", "sample").agg(*weighted_confusion()))
    return by.groupBy("mode").agg(F.collect_list("macro_f1").alias("v")).select("mode", *interval(F.col("v")))


def _score(counts: dict[tuple[str, str | None], int]) -> tuple[float, float, float]:
    per = []
    for c in LABELS:
        tp = counts.get((c, c), 0)
        fp = sum(n for (y, p), n in counts.items() if y != c and p == c)
        fn = sum(n for (y, p), n in counts.items() if y == c and p != c)
        q = lambda a, b: round(a / b, 6) if b else 0.0
        a, b = q(tp, tp + fp), q(tp, tp + fn)
        per.append((q(2.0 * a * b, a + b), a, b))
    return tuple(round(sum(x[i] for x in per) / len(per), 6) for i in range(3))  # type: ignore[return-value]


def seeded_bootstrap(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    """The same with Python's generator, seeded by "seed:split:mode" and drawing rows in case order: exact, but a group's labels and predictions come to one task (thousands of cases)."""
    ship(rows.sparkSession)
    every = rows.select("split", "mode", "case_id", "label", "prediction")
    every = every.unionByName(every.withColumn("split", F.lit("combined")).withColumn("case_id", F.col("case_id"))) if "combined" not in rows.columns else every

    def run(table: pa.Table) -> pa.Table:
        data = sorted(table.to_pylist(), key=lambda r: (r["case_id"]))
        split, mode = data[0]["split"], data[0]["mode"]
        rng = random.Random(f"{seed}:{split}:{mode}")
        values = []
        for _ in range(samples):
            counts: dict = {}
            for _ in data:
                r = data[rng.randrange(len(data))]
                k = (r["label"], r["prediction"])
                counts[k] = counts.get(k, 0) + 1
            values.append(_score(counts))
        out = {"split": [split], "mode": [mode]}
        for i, name in enumerate(("macro_f1", "macro_precision", "macro_recall")):
            v = sorted(x[i] for x in values)
            out |= {f"{name}_lower": [round(v[int(0.025 * (len(v) - 1))], 6)], f"{name}_upper": [round(v[-(-975 * (len(v) - 1) // 1000)], 6)]}
        return pa.table(out)

    names = ", ".join(f"{n}_{e} double" for n in ("macro_f1", "macro_precision", "macro_recall") for e in ("lower", "upper"))
    return every.groupBy("split", "mode").applyInArrow(run, f"split string, mode string, {names}")


def is_correct() -> Column:
    return F.coalesce(F.col("prediction") == F.col("label"), F.lit(False))


def mode_efficiency(rows: DataFrame) -> DataFrame:
    positive = F.col("label") == "positive"
    return rows.groupBy("mode").agg(
        F.count("*").alias("case_count"), ratio(F.count_if(positive & F.coalesce(F.col("prediction") == "positive", F.lit(False))), F.count_if(positive)).alias("recall"),
        *[python_round(F.avg(c)).alias(f"mean_{c}") for c in ("observation_count", "selected_source_bytes", "latency_milliseconds")],
    )


def baseline_summary(rows: DataFrame) -> DataFrame:
    """One row for each mode: how many cases completed and failed, a map of outcomes, observations, bytes, time and errors."""
    by = rows.groupBy("mode", "outcome").agg(F.count("*").alias("n"), F.count_if(F.col("error_count") == 0).alias("ok"), *[F.sum(c).alias(c) for c in ("observation_count", "selected_source_bytes", "downloaded_bytes", "latency_milliseconds", "error_count")])
    return by.groupBy("mode").agg(
        F.sum("n").alias("case_count"), F.sum("ok").alias("completed_case_count"), (F.sum("n") - F.sum("ok")).alias("failed_case_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"),
        F.sum("observation_count").alias("observations"), *[F.sum(c).alias(c) for c in ("selected_source_bytes", "downloaded_bytes", "latency_milliseconds", "error_count")],
    )


def error_outcomes(rows: DataFrame) -> DataFrame:
    """Counts of wrong outcomes for each mode (the cases themselves: error_keys)."""
    y, p = F.col("label"), F.col("prediction")
    return rows.groupBy("mode").agg(
        F.count_if((y == "control") & F.coalesce(p == "positive", F.lit(False))).alias("false_positives"), F.count_if((y == "positive") & F.coalesce(p == "control", F.lit(False))).alias("decisive_false_negatives"),
        F.count_if(p.isNull()).alias("abstentions"), F.count_if((y == "positive") & ~F.coalesce(p == "positive", F.lit(False))).alias("scoring_false_negatives"),
    )


def error_keys(rows: DataFrame) -> DataFrame:
    """One row for each wrong or open case: mode, kind, split, case_id; long lists stay rows."""
    y, p = F.col("label"), F.col("prediction")
    kind = F.when(p.isNull(), "abstention").when((y == "control") & (p == "positive"), "false_positive").when((y == "positive") & (p == "control"), "decisive_false_negative")
    return rows.select("mode", kind.alias("kind"), "split", "case_id").where(F.col("kind").isNotNull())


def _against_one_shot(rows: DataFrame) -> DataFrame:
    first = rows.where("mode = 'one_shot'").select("split", "case_id", is_correct().alias("was_correct"), F.col("observation_count").alias("first_observations"), F.col("prediction").alias("first_prediction"))
    return rows.where("mode <> 'one_shot'").withColumn("correct", is_correct()).join(first, ["split", "case_id"])


def agent_value(rows: DataFrame) -> DataFrame:
    now, was = F.col("correct"), F.col("was_correct")
    return _against_one_shot(rows).groupBy("mode").agg(F.count_if(now & ~was).alias("improved"), F.count_if(~now & was).alias("regressed"), F.count_if(now & was).alias("unchanged_correct"))


def extra_observations(rows: DataFrame) -> DataFrame:
    """Adaptive cases that used more observations than one_shot without correcting it, and why that didn't help."""
    now, was = F.col("correct"), F.col("was_correct")
    r = _against_one_shot(rows).where("mode = 'adaptive' AND observation_count > first_observations").where(~(now & ~was))
    why = (
        F.when(~now & was, "adaptive regressed after requesting more observations").when(F.col("prediction").isNull(), "adaptive remained safely abstaining after more observations")
        .when(F.col("prediction").eqNullSafe(F.col("first_prediction")), "adaptive kept the same decision after more observations").otherwise("adaptive changed the decision without correcting the one-shot result")
    )
    return r.select("split", "case_id", "label", why.alias("reason"))


def coverage(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """Cases that don't appear exactly once in each mode: case_id, mode, n."""
    every = cases.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"))
    counted = rows.groupBy("case_id", "mode").agg(F.count("*").alias("n"))
    return every.join(counted, ["case_id", "mode"], "full").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def representatives(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """The first case by (split, case_id) of each category among the adaptive cases whose trace is complete: category, split, case_id (null: none)."""
    r = _against_one_shot(rows).where("mode = 'adaptive'").join(traces.where("status = 'complete'").select("split", "case_id"), ["split", "case_id"], "left_semi")
    now, was, open_ = F.col("correct"), F.col("was_correct"), F.col("prediction").isNull()
    more = (F.col("observation_count") > F.col("first_observations")) & ~now
    key = F.struct("split", "case_id")
    first = lambda ok: F.min(F.when(ok, key))
    one = r.agg(first((F.col("label") == "positive") & now & ~was).alias("success"), first((F.col("label") == "control") & now).alias("control"), first(open_).alias("abstention"), F.coalesce(first(more & ~open_), first(more)).alias("genuine_limitation"))
    names = ("success", "control", "abstention", "genuine_limitation")
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return one.selectExpr(f"stack({len(names)}, {pairs}) AS (category, k)").select("category", "k.split", "k.case_id")


def leakage(cases: DataFrame, axes: list[str], split: str = "split") -> DataFrame:
    """For each axis how many groups there are and how many span splits (must be 0)."""
    out = None
    for a in axes:
        part = cases.groupBy(F.col(a).alias("g")).agg(F.count_distinct(split).alias("n")).agg(F.lit(a).alias("axis"), F.count("*").alias("unique_groups"), F.count_if(F.col("n") > 1).alias("groups_spanning_splits"))
        out = part if out is None else out.unionByName(part)
    return out


def histogram(cases: DataFrame, value: str, width: float, low: float, high: float) -> DataFrame:
    """Counts by split ("all" for all) and bin; the last bin takes the upper end."""
    bins = F.least(F.floor(F.col(value) / width) * F.lit(width), F.lit(high - width))
    g = cases.withColumn("lower", python_round(bins)).groupingSets([[F.col("split"), F.col("lower")], [F.col("lower")]], F.col("split"), F.col("lower")).agg(F.grouping("split").alias("a"), F.count("*").alias("n"))
    return g.select(F.when(F.col("a") == 1, "all").otherwise(F.col("split")).alias("split"), "lower", python_round(F.col("lower") + width).alias("upper"), "n")


def summary(cases: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    g = cases.groupingSets([[F.col("split")], []], F.col("split")).agg(F.grouping("split").alias("a"), F.count(v).alias("n"), *[python_round(f).alias(n) for n, f in (("minimum", F.min(v)), ("maximum", F.max(v)), ("mean", F.avg(v)), ("median", F.median(v)))])
    return g.withColumn("split", F.when(F.col("a") == 1, "all").otherwise(F.col("split"))).drop("a")


def distribution(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by split ("all" for all) and value of each dimension, in one pass."""
    long = cases.select("split", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")).select("split", "x.*")
    g = long.groupingSets([[F.col("split"), F.col("dimension"), F.col("value")], [F.col("dimension"), F.col("value")]], F.col("split"), F.col("dimension"), F.col("value")).agg(F.grouping("split").alias("a"), F.count("*").alias("n"))
    return g.withColumn("split", F.when(F.col("a") == 1, "all").otherwise(F.col("split"))).drop("a")


def inspection_sample(cases: DataFrame, size: int) -> DataFrame:
    """The first cases by the SHA-256 of split, NUL, case."""
    return cases.withColumn("h", F.sha2(F.concat("split", F.lit("\0"), F.col("case_id").cast("string")), 256)).orderBy("h", "case_id").limit(size).drop("h")


def public_id(split: Column, case_id: Column, benchmark_sha256: str) -> Column:
    return F.concat(split, F.lit("-"), F.substring(F.sha2(F.concat(split, F.lit("\0"), case_id.cast("string"), F.lit("\0" + benchmark_sha256)), 256), 1, 24))


def blind(cases: DataFrame, benchmark_sha256: str, keep: list[str]) -> DataFrame:
    """Cases under an opaque id with the columns named and no label."""
    return cases.select(public_id(F.col("split"), F.col("case_id"), benchmark_sha256).alias("case_id"), *keep)


def claims(efficiency: DataFrame, extra: DataFrame, errors: DataFrame) -> DataFrame:
    """The headline sentences of the error analysis."""
    e = {r["mode"]: r for r in efficiency.collect()}
    w = {r["mode"]: r for r in errors.collect()}
    a, f, n = e["adaptive"], e["fixed_bundle"], extra.count()
    rows = [
        ("mode_efficiency", f"Adaptive recall is {a['recall']}, compared with fixed-bundle recall {f['recall']}; mean observations are {a['mean_observation_count']} versus {f['mean_observation_count']}, respectively."),
        ("extra_observations_without_help", f"{n} adaptive cases used more observations than one-shot without correcting the one-shot result."),
        ("error_outcomes", f"Adaptive produced {w['adaptive']['false_positives']} false positives, {w['adaptive']['decisive_false_negatives']} decisive false negatives, and {w['adaptive']['abstentions']} abstentions."),
    ]
    return efficiency.sparkSession.createDataFrame(rows, "table string, claim string")
