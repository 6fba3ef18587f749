"""Decisions: conditions, the rule table, outcomes, admission under a budget, and the loop over all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermal_lake.functions import checks
from thermal_lake.operators.graph import written

#: Which reasons count as what (the policy and the outcome differ on purpose).
POLICY_POOR = ("coverage_insufficient", "frame_blank", "frame_saturated", "alignment_failed")
OUTCOME_POOR = ("coverage_insufficient", "frame_blank", "frame_saturated", "contrast_low")
ABSENT = ("thermal_evidence_absent", "no_persistent_evidence")
WEAK = ("contrast_low", "thermal_anomaly_weak")
FAILURES = ("source_missing", "source_corrupt", "timeout", "cancelled", "artifact_write_failed", "configuration_invalid")

#: Each rule with the action it wants (or the observation actions it tries, in order) and its reason; the first whose condition holds decides.
RULES = (
    ("tool_failure", "tool_failure_abstain", "abstain", "the prior bounded tool failed; stop with insufficient evidence"),
    ("budget_exhausted", "budget_exhausted_abstain", "abstain", "a configured resource limit is exhausted"),
    ("recovery_retry_exhausted", "recovery_retry_exhausted_abstain", "abstain", "the one permitted recovery retry was already used"),
    ("poor_quality", "poor_quality_retry", ("next_timestamp", "alternate_band", "pre_event_baseline"), "unusable or unaligned evidence requires one allowlisted replacement observation"),
    ("bands_conflict", "bands_conflict_alternate", ("alternate_band", "next_timestamp"), "conflicting bands require the prescribed alternate-band comparison"),
    ("persistent_evidence", "persistent_evidence_review", "request_human_review", "persistent thermal evidence requires human review"),
    ("persistence_absent", "absent_persistence_finalize", "finalize", "the contextual response lacks persistence"),
    ("weak_contextual_contrast", "weak_contextual_followup", ("next_timestamp", "pre_event_baseline"), "weak contextual contrast needs the next prescribed comparison"),
    ("no_decisive_evidence", "no_decisive_evidence_followup", ("next_timestamp", "pre_event_baseline"), "no decisive evidence is present; use the first prescribed comparison"),
)
#: Why a rule abstains if none of its observations is available.
NO_FOLLOWUP = {
    "poor_quality": "poor-quality evidence has no allowlisted replacement observation",
    "bands_conflict": "band conflict has no allowlisted comparison observation",
    "weak_contextual_contrast": "weak contextual contrast has no allowlisted follow-up",
    "no_decisive_evidence": "no allowlisted follow-up observation is available",
}
#: What a reviewer reads for a reason and for an outcome.
REASON_TEXT = {
    "valid": "The supplied observation passed the configured checks.",
    "source_missing": "A required cached source was unavailable.",
    "source_corrupt": "A required source or evidence packet could not be verified.",
    "observation_not_allowed": "The requested observation was not allowlisted.",
    "coverage_insufficient": "Usable image coverage was below the development limit.",
    "frame_blank": "The observation did not contain usable thermal variation.",
    "frame_saturated": "The observation was too clipped or saturated for this check.",
    "contrast_low": "Thermal contrast was too weak for a reliable comparison.",
    "alignment_failed": "Observations could not be aligned reliably for a temporal comparison.",
    "thermal_anomaly_weak": "A thermal anomaly was present but did not meet the persistence threshold.",
    "thermal_evidence_persistent": "Thermal evidence persisted across the required aligned observations.",
    "thermal_evidence_absent": "No contextual thermal evidence was measured in the usable observations.",
    "bands_conflict": "The compared bands disagree and need reviewer interpretation.",
    "budget_exhausted": "The configured observation, byte, or elapsed-time budget was exhausted.",
    "timeout": "Processing reached its configured time limit.",
    "cancelled": "Processing was cancelled before sufficient evidence was available.",
    "artifact_write_failed": "The evidence artifact could not be written completely.",
    "configuration_invalid": "The configured evidence processing parameters were invalid.",
    "human_review_required": "A qualified reviewer must assess this thermal evidence.",
    "insufficient_evidence": "The available evidence is not sufficient for a stronger outcome.",
    "no_persistent_evidence": "No thermal region persisted at the configured development threshold.",
}
OUTCOME_TEXT = {
    "review_escalation": "Review escalation: persistent thermal evidence met the development threshold.",
    "human_review": "Human review: the evidence contains an unresolved conflict.",
    "no_persistent_evidence": "No persistent evidence: the completed usable comparison did not meet the development threshold.",
    "insufficient_evidence": "Insufficient evidence: the case was safely abstained rather than strengthened.",
    "failed": "Evidence processing failed and did not produce a usable outcome.",
}


def texts(c: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in c])


def _any(reasons: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(reasons, texts(of))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# Conditions and the rule table


def exhausted() -> Column:
    out = F.lit(False)
    for r in ("observations", "bytes", "elapsed_seconds"):
        out = out | (F.col(f"used_{r}") >= F.col(f"max_{r}"))
    return out


def conditions(t: checks.Outcome = checks.Outcome()) -> Column:  # noqa: B008
    """The conditions that hold, in their order. Columns: reason_codes, persistence_count, persistence_confidence, last_accepted (null: no tool ran) and the budget's."""
    reasons = F.col("reason_codes")
    poor = _any(reasons, POLICY_POOR)
    found = F.array_compact(F.array(
        F.when(~F.coalesce("last_accepted", F.lit(True)), "tool_failure"),
        F.when(exhausted(), "budget_exhausted"),
        F.when(poor, "poor_quality"),
        F.when(poor & (F.col("used_retries") >= F.col("max_retries")), "recovery_retry_exhausted"),
        F.when(F.array_contains(reasons, "bands_conflict"), "bands_conflict"),
        F.when((F.col("persistence_count") >= t.review_count) & (F.col("persistence_confidence") >= t.review_confidence), "persistent_evidence"),
        F.when(_any(reasons, ABSENT), "persistence_absent"),
        F.when(_any(reasons, WEAK), "weak_contextual_contrast"),
    ))
    return F.when(F.size(found) > 0, found).otherwise(texts(("no_decisive_evidence",)))


def canonical(available: Column) -> Column:
    """Available actions (action_type, observation_id) by the order of types, then id."""
    keyed = F.transform(available, lambda a: F.struct(F.array_position(texts(checks.ACTIONS), a["action_type"]).alias("o"), F.coalesce(a["observation_id"], F.lit("")).alias("i"), a["action_type"].alias("action_type"), a["observation_id"].alias("observation_id")))
    return F.transform(F.array_sort(keyed), lambda a: F.struct(a["action_type"].alias("action_type"), a["observation_id"].alias("observation_id")))


def _first(types: tuple[str, ...]) -> Column:
    """The first available action of the first type that has one (null: none)."""
    return F.coalesce(*[F.get(F.filter("available", lambda a: a["action_type"] == F.lit(t)), F.lit(0)) for t in types])


def _act(kind: str) -> Column:
    return F.struct(F.lit(kind).alias("action_type"), F.lit(None).cast("string").alias("observation_id"))


def decide(df: DataFrame) -> DataFrame:
    """df with conditions, action_type, observation_id, rule, selection_reason and considered (every candidate, its status and why).

    available holds observation actions only. The checks stand in priority order, so the budget comes before persistent evidence, and an exhausted retry counts only while something is available.
    """
    df = df.withColumn("available", canonical(F.col("available"))).withColumn("conditions", conditions())
    chosen = None
    for condition, rule, wanted, why in RULES:
        holds = F.array_contains("conditions", condition)
        if condition == "recovery_retry_exhausted":
            holds = holds & (F.size("available") > 0)
        if condition == "no_decisive_evidence":
            holds = F.lit(True)
        result = lambda action, rule, why: F.struct(action.alias("action"), F.lit(rule).alias("rule"), F.lit(why).alias("why"))
        if isinstance(wanted, str):
            value = result(_act(wanted), rule, why)
        else:
            action = _first(wanted)
            value = F.when(action.isNotNull(), result(action, rule, why)).otherwise(result(_act("abstain"), "no_followup_abstain", NO_FOLLOWUP[condition]))
        chosen = F.when(holds, value) if chosen is None else chosen.when(holds, value)
    df = df.withColumn("_c", chosen)
    df = df.withColumns({"action_type": F.col("_c.action.action_type"), "observation_id": F.col("_c.action.observation_id"), "rule": F.col("_c.rule"), "selection_reason": F.col("_c.why")}).drop("_c")
    every = F.concat(F.col("available"), F.array(*[_act(a) for a in checks.TERMINAL_ACTIONS]))
    same = lambda a: (a["action_type"] == F.col("action_type")) & a["observation_id"].eqNullSafe(F.col("observation_id"))
    considered = F.transform(every, lambda a: F.struct(a["action_type"].alias("action_type"), a["observation_id"].alias("observation_id"), F.when(same(a), "selected").otherwise("rejected").alias("status"), F.when(same(a), F.col("selection_reason")).otherwise("lower priority than the selected rule").alias("reason")))
    return df.withColumn("considered", considered)


# Evidence and outcomes


def snapshot(packets: DataFrame) -> DataFrame:
    """Packets (observations: reason_codes, component_count, candidate_pixels; persistence: count, confidence, reason_codes) to the facts of a decision and of an outcome.

    Reasons keep the order in which they were first seen. A decision counts components; an outcome counts candidate pixels, and observations without a poor reason of its own set.
    """
    reasons = F.array_distinct(F.concat(F.flatten(F.transform("observations", lambda o: o["reason_codes"])), F.col("persistence.reason_codes")))
    total = lambda field: F.aggregate("observations", F.lit(0).cast("long"), lambda a, o: a + o[field])
    usable = F.size(F.filter("observations", lambda o: ~F.arrays_overlap(o["reason_codes"], texts(OUTCOME_POOR))))
    return packets.withColumns({
        "reason_codes": reasons, "component_count": total("component_count"), "candidate_region_count": total("candidate_pixels"), "observation_count": F.size("observations"), "usable_observation_count": usable,
        "persistence_count": F.col("persistence.count"), "persistence_confidence": F.col("persistence.confidence"),
    })


def changes(before: Column, after: Column) -> Column:
    """Fields in which two snapshots differ, as text; empty if there is none before."""
    fields = ("component_count", "persistence_count", "persistence_confidence", "reason_codes", "evidence_ids")
    one = lambda f: F.when(~before[f].eqNullSafe(after[f]), F.struct(F.lit(f).alias("field"), F.to_json(F.struct(before[f].alias("v"))).alias("before"), F.to_json(F.struct(after[f].alias("v"))).alias("after")))
    return F.when(before.isNull(), F.array()).otherwise(F.array_compact(F.array(*[one(f) for f in fields])))


def calibrate(df: DataFrame, t: checks.Outcome = checks.Outcome()) -> DataFrame:  # noqa: B008
    """df with outcome, outcome_reasons, outcome_confidence and explanation."""
    reasons = F.col("reason_codes")
    add = lambda *c: F.array_distinct(F.concat(reasons, texts(c)))
    spent = F.coalesce("budget_exhausted", F.lit(False)) | F.array_contains(reasons, "budget_exhausted")
    poor = _any(reasons, OUTCOME_POOR) | F.array_contains(reasons, "alignment_failed")
    capped = F.least(F.col("persistence_confidence"), F.lit(t.insufficient_confidence))
    out = lambda state, codes, confidence: F.struct(F.lit(state).alias("s"), codes.alias("r"), confidence.cast("double").alias("c"))
    zero = F.lit(0.0)
    review = (F.col("persistence_count") >= t.review_count) & (F.col("persistence_confidence") >= t.review_confidence)
    found = (
        F.when(_any(reasons, FAILURES), out("failed", reasons, zero))
        .when(spent, out("insufficient_evidence", add("budget_exhausted", "insufficient_evidence"), capped))
        .when(poor, out("insufficient_evidence", add("insufficient_evidence"), capped))
        .when(F.array_contains(reasons, "bands_conflict"), out("human_review", add("human_review_required"), zero))
        .when(F.col("usable_observation_count") < t.usable_observations, out("insufficient_evidence", add("insufficient_evidence"), capped))
        .when(review, out("review_escalation", add("thermal_evidence_persistent", "human_review_required"), F.col("persistence_confidence")))
        .when(F.col("candidate_region_count") == 0, out("no_persistent_evidence", add("thermal_evidence_absent", "no_persistent_evidence"), zero))
        .otherwise(out("no_persistent_evidence", add("thermal_anomaly_weak", "no_persistent_evidence"), zero))
    )
    df = df.withColumn("_o", found).withColumns({"outcome": F.col("_o.s"), "outcome_reasons": F.col("_o.r"), "outcome_confidence": F.col("_o.c")}).drop("_o")
    return df.withColumn("explanation", explained(F.col("outcome"), F.col("outcome_reasons")))


def explained(outcome: Column, reasons: Column) -> Column:
    return F.concat_ws(" ", literal_map(OUTCOME_TEXT)[outcome], F.array_join(F.transform(reasons, lambda r: literal_map(REASON_TEXT)[r]), " "))


def prediction(outcome: Column) -> Column:
    return F.when(outcome == "review_escalation", "positive").when(outcome == "no_persistent_evidence", "control")


# Admission


def admission_error() -> Column:
    """Why an observation request is refused (null: admitted), asked in this order. Columns: observation_id, action_type, allowed (map id to action), selected (ids), terminal_action, sources (id to array of source id and bytes), used_sources and the budget's."""
    wanted = F.try_element_at("allowed", F.col("observation_id"))
    fresh = F.filter(F.try_element_at("sources", F.col("observation_id")), lambda s: ~F.array_contains(F.col("used_sources"), s["source_id"]))
    more = F.aggregate(F.coalesce(fresh, F.expr("cast(array() as array<struct<source_id: string, bytes: bigint>>)")), F.lit(0).cast("long"), lambda a, s: a + s["bytes"])
    return (
        F.when(~checks.is_identifier(F.col("observation_id")), "observation_not_allowed").when(wanted.isNull(), "observation_not_allowed").when(wanted != F.col("action_type"), "action_not_allowed")
        .when(F.array_contains("selected", F.col("observation_id")), None).when(F.col("terminal_action").isNotNull(), "terminal").when(F.size("selected") >= F.col("max_observations"), "observation_budget_exhausted")
        .when(F.col("used_elapsed_seconds") >= F.col("max_elapsed_seconds"), "elapsed_time_exhausted").when(F.col("used_bytes") + more > F.col("max_bytes"), "byte_budget_exhausted")
    )


def remaining(allowed: DataFrame, selected: DataFrame) -> DataFrame:
    """The (case_id, observation_id) of a case's allowlist that it hasn't selected yet."""
    return allowed.join(selected.select("case_id", "observation_id"), ["case_id", "observation_id"], "left_anti")


def source_bytes(rows: DataFrame) -> DataFrame:
    """used_bytes and sources of each case: a source that several of its observations share counts once. rows: case_id, source_id, bytes."""
    return rows.groupBy("case_id", "source_id").agg(F.max("bytes").alias("bytes")).groupBy("case_id").agg(F.sum("bytes").alias("used_bytes"), F.count("*").alias("sources"))


def first_seen(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each key's distinct values as the array `reasons`, in the order in which they were first seen."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("reasons"))


def terminal_result(existing: Column, asked: Column) -> Column:
    """What a terminal action gives: accepted the first time, accepted again without effect if it is the same, refused after another one."""
    same = existing == asked
    return F.struct((existing.isNull() | same).alias("accepted"), F.coalesce(same, F.lit(False)).alias("idempotent"), F.when(existing.isNotNull() & ~same, "terminal").alias("error"))


def restored_error() -> Column:
    """Why a state may not be resumed (null: it may). Columns: selected, evidence_ids, allowed (map id to action), max_observations, stored_max_observations, used_bytes, max_bytes."""
    return (
        F.when(F.size("selected") != F.size("evidence_ids"), "unaligned").when(~checks.all_distinct(F.col("selected")) | ~checks.all_distinct(F.col("evidence_ids")), "repeated")
        .when(F.size(F.array_except("selected", F.map_keys("allowed"))) > 0, "not allowed").when(F.col("max_observations") != F.col("stored_max_observations"), "other limits")
        .when((F.size("selected") > F.col("max_observations")) | (F.col("used_bytes") > F.col("max_bytes")), "over the limit")
    )


#: What may be done about a refusal.
RECOVERY = {
    "observation_not_allowed": "Use only an observation listed in this case's allowlist.",
    "action_not_allowed": "Use the action assigned to the allowlisted observation.",
    "observation_budget_exhausted": "Do not request another observation; review the bounded evidence already recorded.",
    "byte_budget_exhausted": "Do not download or substitute data. Start a new approved bounded run only if its byte limit is changed deliberately.",
    "elapsed_time_exhausted": "Do not continue this run. Inspect the recorded timeout and start a fresh approved run only if its time limit is changed deliberately.",
    "terminal": "No further action is permitted for this terminal case.",
    "source_unavailable": "Restore the exact allowlisted source to the verified local cache, then start a fresh bounded run.",
    "source_corrupt": "Replace the cached source with the exact expected bytes and SHA-256, then start a fresh bounded run.",
    "insufficient_disk": "Free local disk space or choose an approved artifact location, then start a fresh bounded run.",
    "artifact_write_failed": "Check the local artifact location and permissions; do not use a partial artifact. Start a fresh bounded run after correcting it.",
    "evidence_failed": "Inspect the recorded configuration or source error and start a fresh bounded run only after it is corrected.",
}


def recovery(error: Column) -> Column:
    return literal_map(RECOVERY)[error]


# The loop


def terminal(df: DataFrame) -> DataFrame:
    """Rows with a terminal action_type to their outcome: an abstention is insufficient evidence at confidence 0; a review request that no stronger outcome backs is a human review."""
    df = calibrate(df)
    reasons = F.when(F.col("used_observations") >= F.col("max_observations"), F.array_union("reason_codes", texts(("budget_exhausted",)))).otherwise(F.col("reason_codes"))
    given_up = F.col("action_type") == "abstain"
    asked = (F.col("action_type") == "request_human_review") & ~F.col("outcome").isin("review_escalation", "human_review")
    df = df.withColumns({
        "outcome_reasons": F.when(given_up, F.array_union(reasons, texts(("insufficient_evidence",)))).when(asked, F.array_union("outcome_reasons", texts(("human_review_required",)))).otherwise(F.col("outcome_reasons")),
        "outcome_confidence": F.when(given_up, F.lit(0.0)).otherwise(F.col("outcome_confidence")),
        "outcome": F.when(given_up, "insufficient_evidence").when(asked, "human_review").otherwise(F.col("outcome")),
    })
    state = F.when(F.col("outcome").isin("review_escalation", "human_review"), "review").when(F.col("outcome") == "no_persistent_evidence", "finalize").when(F.col("outcome") == "insufficient_evidence", "abstain").otherwise("failure")
    return df.withColumn("final_state", state).withColumn("explanation", explained(F.col("outcome"), F.col("outcome_reasons")))


#: The facts a decision needs, and what they are without evidence.
FACTS = {
    "reason_codes": "cast(array() AS array<string>)", "component_count": "0L", "candidate_region_count": "0L", "usable_observation_count": "0", "persistence_count": "0", "persistence_confidence": "0.0D",
}
#: What a case's state holds besides the case: the columns of a checkpoint, and how a new case begins.
STATE = {"selected": "cast(array() AS array<string>)", "used_bytes": "0L", "used_retries": "0", "used_elapsed_seconds": "0.0D", "last_accepted": "cast(null AS boolean)", "transitions": "0"}
LIMITS = ("max_observations", "max_bytes", "max_elapsed_seconds", "max_retries")


def started(cases: DataFrame) -> DataFrame:
    """The state in which each case begins."""
    return cases.withColumns({k: F.expr(v) for k, v in STATE.items()})


def checkpoint(state: DataFrame) -> DataFrame:
    """What has to be kept of cases that are under way to go on later: case_id, the state and the limits it was made under."""
    return state.select("case_id", *STATE, *[F.col(c).alias(f"stored_{c}") for c in LIMITS])


def resumed(cases: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The state of each case as its checkpoint says, or its beginning without one. A checkpoint of an unknown case, of other limits, with a repeated or unknown observation, or over a limit raises."""
    kept = checkpoints.select(F.col("case_id").alias("_of"), *[F.col(c).alias(f"_{c}") for c in STATE], *[f"stored_{c}" for c in LIMITS])
    both = cases.join(kept, F.col("case_id") == F.col("_of"), "full")
    other = F.lit(False)
    for c in LIMITS:
        other = other | (F.col(c) != F.col(f"stored_{c}"))
    asked = both.withColumns({"selected": F.col("_selected"), "evidence_ids": F.col("_selected"), "used_bytes": F.col("_used_bytes"), "allowed": F.map_from_arrays(F.transform("allowlist", lambda x: x["observation_id"]), F.transform("allowlist", lambda x: x["action_type"]))})
    error = F.when(F.col("_of").isNull(), None).when(F.col("case_id").isNull(), "unknown case").when(other, "other limits").otherwise(restored_error())
    asked = asked.withColumn("_e", error).withColumn("case_id", F.when(F.col("_e").isNotNull(), F.raise_error(F.concat(F.lit("can't resume "), F.col("_of").cast("string"), F.lit(": "), F.col("_e"))).cast(cases.schema["case_id"].dataType)).otherwise(F.col("case_id")))
    return asked.select(*cases.columns, *[F.when(F.col("_of").isNull(), F.expr(v)).otherwise(F.col(f"_{k}")).alias(k) for k, v in STATE.items()])


def advance(state: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of all cases: (finished ones with their outcome, the state of the others). The step is written, so it is computed once and plans stay as long as one step.

    A case looks at the evidence of what it selected, decides and acts. A request is refused if its bytes would exceed the budget or the time is used up, before it or by the request itself (seconds of its allowlist entry, if these are given);
    the time passes then, too.
    """
    e = evidence.select(F.col("case_id").alias("_case"), F.col("selected_key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in FACTS])
    known = state.join(e, (F.col("case_id") == F.col("_case")) & (F.array_join(F.array_sort("selected"), ",") == F.col("_key")), "left")
    known = known.withColumns({c: F.coalesce(f"_{c}", F.expr(d)) for c, d in FACTS.items()} | {"used_observations": F.size("selected"), "budget_exhausted": F.lit(False)})
    open_ = F.transform(F.filter("allowlist", lambda a: ~F.array_contains(F.col("selected"), a["observation_id"])), lambda a: F.struct(a["action_type"].alias("action_type"), a["observation_id"].alias("observation_id")))
    chosen = written(decide(known.withColumn("available", open_)), "loop-round")
    ends = F.col("action_type").isin(*checks.TERMINAL_ACTIONS)
    # observe (and analyze, if there is evidence), decide, act
    steps = F.col("transitions") + F.when(F.col("last_accepted") == F.lit(False), 0).otherwise(F.when(F.size("selected") > 0, 2).otherwise(1)) + 2
    done = ["case_id", "outcome", "outcome_reasons", "outcome_confidence", "final_state", "explanation", "rule", "selected", "used_bytes", "used_retries", "used_elapsed_seconds", "transitions"]
    finished = terminal(chosen.where(ends).withColumn("transitions", steps)).select(*done)
    entry = F.element_at(F.filter("allowlist", lambda a: a["observation_id"] == F.col("observation_id")), 1)
    timed = "seconds" in state.schema["allowlist"].dataType.elementType.names  # type: ignore[union-attr]
    size, seconds = F.coalesce(entry["bytes"], F.lit(0)), F.coalesce(entry["seconds"], F.lit(0.0)) if timed else F.lit(0.0)
    begun = (F.col("used_bytes") + size <= F.col("max_bytes")) & (F.col("used_elapsed_seconds") < F.col("max_elapsed_seconds"))
    fits = begun & (F.col("used_elapsed_seconds") + seconds <= F.col("max_elapsed_seconds"))
    going = chosen.where(~ends).withColumn("transitions", steps).withColumns({
        "used_retries": F.col("used_retries") + F.when(F.col("rule") == "poor_quality_retry", 1).otherwise(0), "last_accepted": fits, "used_elapsed_seconds": F.col("used_elapsed_seconds") + F.when(begun, seconds).otherwise(0.0),
        "selected": F.when(fits, F.array_append("selected", F.col("observation_id"))).otherwise(F.col("selected")), "used_bytes": F.col("used_bytes") + F.when(fits, size).otherwise(0),
    })
    return finished, going.select(*state.columns)


def run_loop(cases: DataFrame, evidence: DataFrame, rounds: int, checkpoints: DataFrame | None = None) -> DataFrame:
    """All cases through observe, analyze, decide and act, a step for all of them at once; at most `rounds` observations each.

    cases: case_id, allowlist (array of action_type, observation_id, bytes and, if time counts, seconds), max_observations, max_bytes, max_elapsed_seconds, max_retries. evidence: case_id, selected_key (ids of the
    observations seen, sorted and comma-joined), and the facts of snapshot(). A refusal (see advance()) abstains. checkpoints: cases go on from these.
    Returns one row a case with the outcome, selected, used_bytes, used_retries, used_elapsed_seconds and transitions (number of state changes).
    """
    state = started(cases) if checkpoints is None else resumed(cases, checkpoints)
    done = None
    for _ in range(rounds + 2):
        finished, state = advance(state, evidence)
        done = finished if done is None else done.unionByName(finished)
        if state.isEmpty():
            break
    return done
