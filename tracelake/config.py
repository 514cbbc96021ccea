"""Settings of a cohort run."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import constants as C


@dataclass(frozen=True)
class ArtifactSettings:
    mode: str = C.ARTIFACT_MODE
    intensity_limit: float = C.INTENSITY_LIMIT
    quality_pct: float = C.QUALITY_LIMIT_PCT
    min_electrodes: int = C.MIN_CLEAN_ELECTRODES
    exclude_blank: bool = True


@dataclass(frozen=True)
class EventSettings:
    mode: str = "none"
    threshold: float = 0.5


@dataclass(frozen=True)
class BinSettings:
    edges: tuple[float, ...] = tuple(C.DEFAULT_BIN_EDGES)
    min_hours: float = C.MIN_COVERAGE_HOURS
    continuity_threshold: float = C.CONTINUITY_THRESHOLD


@dataclass(frozen=True)
class CohortSettings:
    artifact: ArtifactSettings = field(default_factory=ArtifactSettings)
    event: EventSettings = field(default_factory=EventSettings)
    bins: BinSettings = field(default_factory=BinSettings)
    require_both_sides: bool = False
    epoch_seconds: float = 1.0
