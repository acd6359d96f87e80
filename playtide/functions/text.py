"""Classes of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes in the order in which they are tried, with the parts that name them.
PLATFORMS = {"ios": ["ios"], "osx": ["osx", "mac"], "windows": ["windows", "win"], "android": ["android"], "web": ["web", "browser"]}


def platform_class(raw: Column) -> Column:
    """The first class of ``PLATFORMS`` that ``raw`` names in either case; null and empty: unknown, none: other."""
    found = F.when(raw.isNull() | (raw == ""), "unknown")
    for name, parts in PLATFORMS.items():
        found = found.when(F.lower(raw).rlike("|".join(parts)), name)
    return found.otherwise("other")
