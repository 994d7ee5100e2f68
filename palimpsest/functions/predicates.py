"""Predicates and small projections as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_at(now: int) -> Column:
    """Memories: begun and not ended."""
    return (F.col("valid_from") <= now) & (F.col("valid_until").isNull() | (F.col("valid_until") > now))


def visible_at(now: int, prefix: str = "") -> Column:
    """Graph rows: not ended; the begin isn't looked at."""
    end = F.col(prefix + "valid_until")
    return end.isNull() | (end > now)


def expired_at(now: int) -> Column:
    return F.col("valid_until") <= now


def recallable(now: int, layer: str | None = None, with_procedural: bool = False) -> Column:
    """Valid, and of one layer; without a layer procedural memories are left out unless asked for."""
    keep = valid_at(now)
    if layer is not None:
        return keep & (F.col("layer") == layer)
    return keep if with_procedural else keep & (F.col("layer") != "procedural")


def trust(source: str = "source") -> Column:
    c = F.col(source)
    return F.when(c.isin("user", "consolidation", "import"), c).otherwise("unknown")


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def retention_score(now: int, half_life: float) -> Column:
    h = max(1.0, float(half_life))
    importance = F.when(F.isnan("importance") | (F.abs("importance") == float("inf")), 0.0).otherwise(F.col("importance"))
    return importance + h / (h + F.greatest(F.lit(0), F.lit(now) - F.col("last_access")))
