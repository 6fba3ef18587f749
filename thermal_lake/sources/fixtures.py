"""Deterministic synthetic frames with known answers, and their digests."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Seed, size, background and heat of the frames, and the digests that they have to have.
SEED, SIZE, BACKGROUND, NOISE, HEAT, CLIPPED = 20260819, 12, 290.0, 0.25, 325.0, 350.0
BUNDLE_SHA256 = "16aa75e10db7f9f20e2f665e26f9a29e07bf60815f5673b890f6d4e2b356e007"
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Case:
    name: str
    frames: tuple[np.ndarray, ...]
    valid: tuple[np.ndarray, ...]
    heat: tuple[np.ndarray, ...]
    reason: str

    def digest(self) -> str:
        """SHA-256 of the name and, for frames, validity and heat, each array's type, shape and bytes."""
        h = hashlib.sha256(self.name.encode())
        for group in (self.frames, self.valid, self.heat):
            for a in group:
                h.update(str(a.dtype).encode())
                h.update(np.asarray(a.shape, dtype="<i8").tobytes())
                h.update(np.ascontiguousarray(a).tobytes())
        return h.hexdigest()


def cases() -> list[Case]:
    """The seven cases; each draw follows the one before it from a single generator."""
    rng = np.random.default_rng(SEED)
    shape = (SIZE, SIZE)
    draw = lambda: rng.normal(BACKGROUND, NOISE, shape).astype(np.float32)
    everywhere, nowhere = np.ones(shape, dtype=bool), np.zeros(shape, dtype=bool)

    def hot(at: tuple[int, int] | None, value: float = HEAT) -> tuple[np.ndarray, np.ndarray]:
        frame, mask = draw(), nowhere.copy()
        if at:
            mask[at[0] : at[0] + 2, at[1] : at[1] + 2] = True
            frame[mask] = value
        return frame, mask

    out = []
    for name, places, reason in (
        ("persistent_heat", [(3, 4), (3, 4)], "thermal_evidence_persistent"),
        ("transient_heat", [(3, 4), None], "no_persistent_evidence"),
        ("image_shift", [(3, 4), (4, 2)], "valid"),
    ):
        made = [hot(p) for p in places]
        out.append(Case(name, tuple(f for f, _ in made), (everywhere, everywhere), tuple(m for _, m in made), reason))
    frame, _ = hot((2, 3))
    half = everywhere.copy()
    half[:7] = False
    out.append(Case("missing_pixels", (frame,), (half,), (nowhere,), "coverage_insufficient"))
    frame, _ = hot((6, 6), CLIPPED)
    out.append(Case("saturated_pixels", (frame,), (everywhere,), (nowhere,), "frame_saturated"))
    flat = (300.0 + rng.uniform(-0.004, 0.004, shape)).astype(np.float32)
    out.append(Case("low_contrast", (flat,), (everywhere,), (nowhere,), "contrast_low"))
    out.append(Case("empty_frame", (np.zeros(shape, dtype=np.float32),), (everywhere,), (nowhere,), "frame_blank"))
    return out


def bundle_digest(found: list[Case]) -> str:
    return hashlib.sha256("".join(f"{c.name}:{c.digest()}\n" for c in found).encode()).hexdigest()


def pixels(spark: SparkSession) -> DataFrame:
    """The frames as pixel rows: case, frame_index, frame_id, row, col, v7, invalid, expected_heat."""
    rows = [
        (c.name, k, f"{c.name}/{k}", r, col, float(f[r, col]), not bool(v[r, col]), bool(m[r, col]))
        for c in cases() for k, (f, v, m) in enumerate(zip(c.frames, c.valid, c.heat, strict=True)) for r in range(SIZE) for col in range(SIZE)
    ]
    return spark.createDataFrame(rows, "case string, frame_index int, frame_id string, row int, col int, v7 float, invalid boolean, expected_heat boolean")
