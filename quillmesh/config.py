"""Settings of the engine, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from quillmesh.functions import tables as T


class ConfigurationError(ValueError):
    """A setting out of its range; the message names it."""


@dataclass(frozen=True)
class EngineConfig:
    """Limits and switches. All counts must be positive, all scores within 0 and 1."""

    input_chars: int = T.INPUT_CHARS
    segments: int = T.SEGMENTS
    beam: int = 20
    candidates: int = 10
    symbol_readings: int = 8
    batch: int = 256
    search_candidates: int = T.CANDIDATES
    per_channel: int = T.PER_LIST
    entities: int = T.ENTITIES
    entity_chars: int = T.ENTITY_CHARS
    strong_gap: float = 0.15
    duplicate_threshold: float = 0.85
    pattern_threshold: float = 0.75
    semantic: bool = False
    phonetic: bool = False
    rebus: bool = True
    weights: dict[str, float] = field(default_factory=lambda: dict(T.PROFILES["general_similarity"]))

    def __post_init__(self) -> None:
        for name in ("input_chars", "segments", "beam", "candidates", "symbol_readings", "batch", "search_candidates", "per_channel", "entities", "entity_chars"):
            if getattr(self, name) < 1:
                raise ConfigurationError(f"{name} must be at least 1")
        for name in ("strong_gap", "duplicate_threshold", "pattern_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ConfigurationError(f"{name} must lie within 0 and 1")
        if any(not math.isfinite(w) or w < 0 for w in self.weights.values()) or not any(self.weights.values()):
            raise ConfigurationError("weights must be finite, not negative, and not all zero")
        if set(self.weights) - set(T.CHANNELS):
            raise ConfigurationError(f"no such channels: {sorted(set(self.weights) - set(T.CHANNELS))}")
