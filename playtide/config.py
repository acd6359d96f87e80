"""Parameters of the play and chart rules."""

from __future__ import annotations

from dataclasses import dataclass

US_PER_MS = 1_000
US_PER_HOUR = 3_600_000_000
US_PER_DAY = 24 * US_PER_HOUR
#: Local time is a fixed shift from UTC, whatever the country of a play.
LOCAL_SHIFT_US = 8 * US_PER_HOUR


@dataclass(frozen=True)
class PlayFilters:
    """Counting rules of logical plays."""

    min_ms: int = 30_000
    dynamic_threshold: bool = True
    ratio: float = 0.1
    max_gap_minutes: int = 5
    overlap_tolerance_us: int = 2_000_000


@dataclass(frozen=True)
class ChartConfig:
    """Weekly chart: size, and the day (Monday 0) and hour on which a week starts."""

    top_n: int = 30
    week_start_dow: int = 0
    week_start_hour: int = 0
