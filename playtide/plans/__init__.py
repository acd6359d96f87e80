"""Registered queries and the SQL that checks them."""

from playtide.plans import archive, changes, charts, comparison, entities, feed, habits, identity, incremental, merging, ownership, panels, playback_records, record_scans, published, rankings, review, searching, selection, staging, stats, streams, timeline  # noqa: F401  each registers its queries
from playtide.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
