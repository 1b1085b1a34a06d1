"""Roll-ups of the audit log: hourly counts with mergeable sketches, for any period.

A roll-up is written once and merged for each question, so a dashboard over a year
reads hours, not events.  Counts and sums merge exactly; distinct users by a
HyperLogLog sketch of 2^12 registers (standard error 1.6 %), quantiles by a KLL
sketch of k = 200 (rank error 1.7 % at 99 % confidence).  Estimates depend, within
these errors, on the order in which sketches are merged; counts do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_REGISTERS = 12
KLL_K = 200
#: Standard error of a distinct count and the rank error of a quantile.
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
RANK_ERROR = 0.0172


def hourly(events: DataFrame, dimensions: Sequence[str] = ("tenant_id", "action", "event_type"), ts: str = "ts",
           user: str = "user_id", value: str = "processing_ms", risk: str = "risk_score") -> DataFrame:
    """One row per hour and dimension values; partial aggregation leaves few rows to shuffle.

    Events without a time fall into the hour null, which no period covers.  Null users and values are not sketched.
    """
    return events.groupBy(F.date_trunc("hour", ts).alias("hour"), *dimensions).agg(
        F.count("*").alias("events"), F.count_if(F.col(risk) > 0.7).alias("high_risk"),
        F.count(F.col(value)).alias("timed"), F.sum(value).alias("total_ms"), F.max(value).alias("max_ms"),
        F.hll_sketch_agg(user, LOG_REGISTERS).alias("users"),
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), KLL_K).alias("latency"))


def coarser(rollup: DataFrame, unit: str, dimensions: Sequence[str] = ("tenant_id", "action", "event_type")) -> DataFrame:
    """The roll-up by day, week or month, from the hours."""
    return _merged(rollup.withColumn("hour", F.date_trunc(unit, "hour")), ["hour", *dimensions])


def _merged(rollup: DataFrame, by: Sequence[str]) -> DataFrame:
    return rollup.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("events", "high_risk", "timed", "total_ms")], F.max("max_ms").alias("max_ms"),
        F.hll_union_agg("users").alias("users"), F.kll_merge_agg_bigint("latency", KLL_K).alias("latency"))


def period(rollup: DataFrame, start: Column, end: Column, *by: str, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Counts, estimated distinct users and latency quantiles of the hours in ``[start, end)``, per values of ``by``.

    ``start`` and ``end`` are whole hours.  The filter is on the roll-up's ``hour``, so a table partitioned by day is
    pruned.  Groups without a value have null quantiles.
    """
    merged = _merged(rollup.where((F.col("hour") >= start) & (F.col("hour") < end)), by)
    known = F.when(F.col("timed") > 0, F.col("latency"))
    return merged.select(
        *by, "events", "high_risk", F.floor(F.col("total_ms") / F.col("timed")).alias("avg_ms"), "max_ms",
        F.hll_sketch_estimate("users").alias("users"),
        *[F.kll_sketch_get_quantile_bigint(known, F.lit(q)).alias(f"p{round(100 * q)}") for q in quantiles])
