"""The choice between scanning matches and searching the index, by selectivity."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.config import FilterConfig


@dataclass(frozen=True)
class Plan:
    strategy: str
    selectivity: float
    ef: int


def plan_counts(matches: int, live: int, k: int, ef: int, default_ef: int, config: FilterConfig = FilterConfig()) -> Plan:
    """UNFILTERED is decided by the caller; here a filter is given."""
    if k < 1:
        raise ValueError(f"k is {k}, but at least 1 is needed")
    if not matches:
        return Plan("NO_MATCH", 0.0, 0)
    share = matches / live
    if share < config.exact_below:
        return Plan("EXACT_SCAN", share, 0)
    # A filter may lower an ef that was asked for: the limit holds for both.
    return Plan("FILTERED_INDEX", share, min(config.max_ef, max(ef or default_ef, k) * math.ceil(1 / share)))


def plan(points: DataFrame, predicate: Column | None, k: int, ef: int, default_ef: int, config: FilterConfig = FilterConfig()) -> Plan:
    """One aggregation over the points, without their vectors, says how selective the predicate is."""
    if predicate is None:
        return Plan("UNFILTERED", 1.0, max(ef or default_ef, k))
    row = points.agg(F.count_if(predicate).alias("matches"), F.count("*").alias("live")).first()
    return plan_counts(row.matches, row.live, k, ef, default_ef, config)


def plan_column(matches: Column, live: Column, k: int, ef: int, default_ef: int, config: FilterConfig = FilterConfig()) -> list[Column]:
    """strategy, selectivity and ef as columns over counts, for many filters at once."""
    share = matches / live
    none, few = matches == 0, share < config.exact_below
    grown = F.least(F.lit(config.max_ef).cast("long"), F.lit(max(ef or default_ef, k)) * F.ceil(live / matches))
    return [F.when(none, "NO_MATCH").when(few, "EXACT_SCAN").otherwise("FILTERED_INDEX").alias("strategy"), F.when(none, 0.0).otherwise(share).alias("selectivity"), F.when(none | few, F.lit(0).cast("long")).otherwise(grown).alias("ef")]
