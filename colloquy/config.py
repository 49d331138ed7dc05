"""Settings of the operators with their defaults and limits."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Thresholds, lengths in milliseconds and counts that results depend on."""

    confirm: float = 0.55
    tentative: float = 0.40
    min_duration_ms: int = 1_500
    continuity_ms: int = 15_000
    window_ms: int = 300_000
    window_step_ms: int = 240_000
    late_margin_ms: int = 30_000
    clip_target_ms: int = 300_000
    clip_max_ms: int = 360_000
    silence_close_ms: int = 1_500
    cluster_distance: float = 0.4
    cluster_min_segments: int = 3
    cluster_min_ms: int = 8_000
    min_window_bytes: int = 60

    def clamped(self) -> Settings:
        """Every setting within its limits; a step longer than its window becomes the window."""
        unit = lambda x: min(max(x, 0.0), 1.0)
        out = replace(self, confirm=unit(self.confirm), tentative=min(unit(self.tentative), unit(self.confirm)), cluster_distance=min(max(self.cluster_distance, 0.0), 2.0))
        numbers = {f.name: max(0, getattr(out, f.name)) for f in fields(out) if isinstance(getattr(out, f.name), int)}
        out = replace(out, **numbers)
        window = max(1, out.window_ms)
        return replace(out, window_ms=window, window_step_ms=min(max(1, out.window_step_ms), window), clip_max_ms=max(out.clip_max_ms, out.clip_target_ms))


DEFAULTS = Settings()
