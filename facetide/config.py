"""Job settings. Unknown names raise, so a misspelt setting is never silently ignored."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


def _from_mapping(cls, settings: Mapping[str, object]):
    known = {field.name for field in fields(cls)}
    unknown = sorted(set(settings) - known)
    if unknown:
        raise ValueError(f"unknown setting(s) {unknown}; known: {sorted(known)}")
    return cls(**settings)


@dataclass(frozen=True)
class IngestSettings:
    bootstrap: str = "kafka:29092"
    topic: str = "test_topic"
    starting_offsets: str = "latest"
    fail_on_data_loss: bool = False
    max_offsets_per_trigger: int | None = None
    trigger: str = "5 seconds"
    out_path: str = "data/parquet_events_v2"
    checkpoint_path: str = "data/checkpoints/parquet_events_v2"

    @classmethod
    def of(cls, settings: Mapping[str, object]) -> "IngestSettings":
        return _from_mapping(cls, settings)


@dataclass(frozen=True)
class LiveSettings:
    """Parameters of the frame-to-event path."""

    # The defaults.
    detect_every_n: int = 3
    hold_ms: float = 450.0
    min_confidence: float = 0.45
    match_overlap: float = 0.25
    track_ttl_ms: float = 900.0
    ema_alpha: float = 0.65
    vote_window: int = 15
    min_score: float = 0.55
    confirm_frames: int = 6
    send_interval: float = 0.5

    # The floors.
    LOWEST_TTL_MS = 200.0
    LOWEST_VOTE_WINDOW = 3

    @property
    def ttl_seconds(self) -> float:
        return max(self.LOWEST_TTL_MS, self.track_ttl_ms) / 1000.0

    @property
    def votes(self) -> int:
        return max(self.LOWEST_VOTE_WINDOW, self.vote_window)

    @classmethod
    def of(cls, settings: Mapping[str, object]) -> "LiveSettings":
        return _from_mapping(cls, settings)
