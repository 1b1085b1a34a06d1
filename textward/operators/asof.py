"""As-of and interval joins: what was known at the time of an event."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: Rows without a key or a time match nothing; they are dealt over so many groups.
UNMATCHED = 1024

_HEAD, _STATE, _EVENT = 0, 1, 2


def as_of_join(
    events: DataFrame, states: DataFrame, keys: Sequence[str], at: str, since: str, values: Sequence[str],
    tie: str, bucket_seconds: int = 86_400, strict: bool = False,
) -> DataFrame:
    """Append to each event the ``values`` of its key's last state with ``since <= at`` (``< at`` if strict).

    Events and states are united and cut by (key, bucket of time), so a key that holds a third of all rows is worked
    on by as many tasks as it has buckets; inside a bucket the last state seen is carried along the order of time.  The
    state a bucket starts with is found from one row per (key, bucket), the last state of each, and joins the bucket as
    its first row.  Every event is shuffled once.

    States of one key and time are ordered by ``tie``, the greatest counts.  Events without a key or a time, or before
    the first state of their key, get nulls; states without either are left out.  Repeated events stay repeated.
    The names of ``values`` must not be columns of the events.
    """
    if clash := {c.lower() for c in events.columns} & {v.lower() for v in values}:
        raise ValueError(f"columns of events and states have equal names: {sorted(clash)}")
    fixed, old = list(keys), list(events.columns)
    hashed = [F.col(f"`{f.name}`") for f in events.schema if not isinstance(f.dataType, (MapType, VariantType))]
    time = F.unix_micros(F.col(at).cast("timestamp"))
    width = bucket_seconds * 1_000_000
    bucket = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    known = lambda t: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in fixed], t.isNotNull())
    value = F.struct(*[F.col(v) for v in values])
    moment = F.unix_micros(F.col(since).cast("timestamp"))
    stated = states.where(known(moment)).select(
        *fixed, moment.alias("_t"), F.col(tie).alias("_tie"), value.alias("_value"))
    row = F.struct(*[F.col(f"`{c}`") for c in old])
    kind = lambda k: F.lit(k).alias("_kind")
    nothing = lambda column: F.lit(None).cast(stated.schema[column].dataType).alias(column)
    asked = events.select(
        *fixed, time.alias("_t"), nothing("_tie"), nothing("_value"), kind(_EVENT), row.alias("_row"),
        F.when(known(time), bucket(time)).otherwise(-F.pmod(F.xxhash64(*hashed), F.lit(UNMATCHED))).alias("_bucket"),
        known(time).alias("_known"))
    no_row = F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")
    told = stated.select("*", kind(_STATE), no_row, bucket(F.col("_t")).alias("_bucket"), F.lit(True).alias("_known"))
    rows = asked.unionByName(told).unionByName(_heads(asked, told, fixed, no_row, width))
    if strict:  # an event precedes the states of its own moment
        order = F.when(F.col("_kind") == _EVENT, 1).when(F.col("_kind") == _STATE, 2).otherwise(0)
    else:
        order = F.col("_kind")
    w = Window.partitionBy(*fixed, "_bucket", "_known").orderBy("_t", order, F.col("_tie").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.when(F.col("_known"), F.last("_value", ignorenulls=True).over(w))
    seen = rows.select("_kind", "_row", last.alias("_last")).where(F.col("_kind") == _EVENT)
    return seen.select("_row.*", *[F.col(f"_last.`{v}`").alias(v) for v in values])


def _heads(asked: DataFrame, told: DataFrame, keys: list[str], no_row: Column, width: int) -> DataFrame:
    """One row per (key, bucket) that events ask in: the last state of the key's earlier buckets."""
    by = [*keys, "_bucket"]
    last = F.max_by(F.struct("_value", "_tie"), F.struct("_t", "_tie")).alias("_end")
    ends = told.groupBy(*by).agg(last)
    wanted = asked.where("_known").select(*by).distinct().withColumn("_asked", F.lit(True))
    steps = wanted.join(ends, by, "full")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select(*by, "_asked", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return carried.where("_asked AND _carried IS NOT NULL").select(
        *keys, (F.col("_bucket") * width).alias("_t"), F.col("_carried._tie").alias("_tie"),
        F.col("_carried._value").alias("_value"), F.lit(_HEAD).alias("_kind"), no_row, "_bucket", F.lit(True).alias("_known"))
