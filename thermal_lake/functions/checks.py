"""Validators: columns that are true for a proper value, and frozen parameter sets that check themselves on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The domains of the record formats.
IDENTIFIER = r"^[a-z0-9][a-z0-9_-]{0,79}\z"
MEASUREMENT_NAME = r"^[a-z][a-z0-9_]{0,79}\z"
SHA256 = r"^[0-9a-f]{64}\z"
CHANNELS = ("C07", "C14")
UNITS = ("K", "km2", "px", "s", "B", "deg", "1")
ROLES = ("baseline", "initial", "later", "alternate")
OBSERVATION_ACTIONS = ("next_timestamp", "alternate_band", "pre_event_baseline")
TERMINAL_ACTIONS = ("finalize", "abstain", "request_human_review")
ACTIONS = (*OBSERVATION_ACTIONS, *TERMINAL_ACTIONS)
OUTCOMES = ("review_escalation", "human_review", "no_persistent_evidence", "insufficient_evidence", "failed")
REASONS = (
    "valid", "source_missing", "source_corrupt", "observation_not_allowed", "coverage_insufficient", "frame_blank", "frame_saturated",
    "contrast_low", "alignment_failed", "thermal_anomaly_weak", "thermal_evidence_persistent", "thermal_evidence_absent", "bands_conflict",
    "budget_exhausted", "timeout", "cancelled", "artifact_write_failed", "configuration_invalid", "human_review_required",
    "insufficient_evidence", "no_persistent_evidence",
)


def present(ok: Column) -> Column:
    return F.coalesce(ok, F.lit(False))


def is_identifier(c: Column) -> Column:
    return present(c.rlike(IDENTIFIER))


def is_sha256(c: Column) -> Column:
    return present(c.rlike(SHA256))


def is_measurement_name(c: Column) -> Column:
    return present(c.rlike(MEASUREMENT_NAME))


def is_text(c: Column) -> Column:
    return present((F.length(c) > 0) & (F.trim(c) == c))


def is_count(c: Column, least: int = 0) -> Column:
    return present(c >= least)


def is_finite(c: Column) -> Column:
    return present(~F.isnan(c) & (F.abs(c) < float("inf")))


def is_between(c: Column, low: float, high: float) -> Column:
    return is_finite(c) & present(c.between(low, high))


def is_one_of(c: Column, domain: tuple[str, ...]) -> Column:
    return present(c.isin(*domain))


def all_distinct(c: Column) -> Column:
    return present(F.size(F.array_distinct(c)) == F.size(c))


def are_reasons(c: Column) -> Column:
    """An array of known, distinct reason codes."""
    return all_distinct(c) & present(F.forall(c, lambda x: x.isin(*REASONS)))


def within_budget() -> Column:
    """used_* is at most max_* for all four resources, and nothing is negative."""
    ok = F.lit(True)
    for r in ("observations", "bytes", "elapsed_seconds", "retries"):
        ok = ok & present((F.col(f"used_{r}") >= 0) & (F.col(f"used_{r}") <= F.col(f"max_{r}")))
    return ok


def measurement_ok(value: Column, missing_reason: Column) -> Column:
    """Either a finite value or a reason why it is missing, never both."""
    return F.when(value.isNull(), is_text(missing_reason)).otherwise(is_finite(value) & missing_reason.isNull())


def bounds_ok(south: Column, west: Column, north: Column, east: Column) -> Column:
    return is_between(south, -90, 90) & is_between(north, -90, 90) & is_between(west, -180, 180) & is_between(east, -180, 180) & present(south < north) & present(west < east)


def window_ok(start: Column, stop: Column) -> Column:
    """A half-open range of indices with something in it."""
    return present((start >= 0) & (stop > start))


class Parameters:
    """Base of parameter sets: every number finite, then the set's own rules."""

    def __post_init__(self) -> None:
        for f in fields(self):  # type: ignore[arg-type]
            v = getattr(self, f.name)
            if isinstance(v, float) and not math.isfinite(v):
                raise ValueError(f"{f.name} must be finite")
        for rule, ok in self.rules().items():
            if not ok:
                raise ValueError(rule)

    def rules(self) -> dict[str, bool]:
        return {}


@dataclass(frozen=True)
class Quality(Parameters):
    minimum_coverage: float = 0.75
    maximum_saturated: float = 0.02
    minimum_span: float = 0.05
    minimum_deviation: float = 0.01
    blank_maximum: float = 1.0
    saturation_minimum: float | None = None
    saturation_maximum: float | None = 350.0

    def rules(self) -> dict[str, bool]:
        low, high = self.saturation_minimum, self.saturation_maximum
        return {
            "coverage and saturation are fractions above 0": 0 < self.minimum_coverage <= 1 and 0 < self.maximum_saturated <= 1,
            "span and deviation are above 0": self.minimum_span > 0 and self.minimum_deviation > 0,
            "one saturation endpoint, at least, in order": (low is not None or high is not None) and (low is None or high is None or low < high),
        }


@dataclass(frozen=True)
class Anomaly(Parameters):
    background_kernel: int = 5
    minimum_contrast: float = 2.0
    minimum_difference: float = 25.0
    morphology_kernel: int = 3
    minimum_area: int = 8
    minimum_edge_distance: int = 1

    def rules(self) -> dict[str, bool]:
        odd = lambda k: k >= 1 and k % 2 == 1
        return {
            "kernels are odd": odd(self.background_kernel) and odd(self.morphology_kernel),
            "thresholds are above 0": self.minimum_contrast > 0 and self.minimum_difference > 0,
            "area is 1 at least, edge distance not negative": self.minimum_area >= 1 and self.minimum_edge_distance >= 0,
        }


@dataclass(frozen=True)
class Persistence(Parameters):
    maximum_resample_km: float = 5.0
    maximum_centroid_km: float = 10.0
    minimum_iou: float = 0.1
    minimum_area: int = 1

    def rules(self) -> dict[str, bool]:
        return {"distances are above 0": self.maximum_resample_km > 0 and self.maximum_centroid_km > 0, "overlap is a fraction": 0 <= self.minimum_iou <= 1, "area is 1 at least": self.minimum_area >= 1}


@dataclass(frozen=True)
class Tile(Parameters):
    physical_minimum: float = 180.0
    physical_maximum: float = 400.0
    lower_quantile: float = 0.02
    upper_quantile: float = 0.98
    minimum_valid_coverage: float = 0.5

    def rules(self) -> dict[str, bool]:
        return {"range is in order": self.physical_minimum < self.physical_maximum, "quantiles are in order": 0 <= self.lower_quantile < self.upper_quantile <= 1, "coverage is a fraction above 0": 0 < self.minimum_valid_coverage <= 1}


@dataclass(frozen=True)
class Outcome(Parameters):
    review_count: int = 2
    review_confidence: float = 0.5
    usable_observations: int = 2
    insufficient_confidence: float = 0.49

    def rules(self) -> dict[str, bool]:
        return {"counts are 2 at least": self.review_count >= 2 and self.usable_observations >= 2, "confidences are fractions, the review's above the other": 0 <= self.insufficient_confidence < self.review_confidence <= 1}
