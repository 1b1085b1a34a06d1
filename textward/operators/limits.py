"""Rate limits replayed over event logs.

Admission depends on earlier admissions, so each key is an ordered fold.  It is cut into buckets of time in three
steps, none of which holds a key's calls.  Every task packs the times of its own calls by (key, bucket).  A chain per
key reads the packed times in order and notes the state in which each bucket begins; it jumps from one admitted call
to the next, of which the limit itself allows only so many in any time, whatever the number of calls.  Then all
buckets are decided in parallel, each from its own state, as streams of Arrow batches: calls of a key that never
pauses are decided by many tasks.

Times and levels are integers (microseconds), so results don't depend on how a key is cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C

MICROS = 1_000_000
#: Seconds of a bucket of time, whose calls of one key are decided by one task.
HOURS = 6 * 3600
#: Place of the state that a key brings along, before all its buckets, and of the one in which it ends.
BEFORE, AFTER = -(1 << 62), 1 << 62


def _micros(ts: str) -> Column:
    """Microseconds of a time; calls without a time count as made at the epoch."""
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0))


def activity_segments(df: DataFrame, keys, ts: str, gap_seconds: float, bucket_seconds: int = 3600) -> DataFrame:
    """Append ``segment``: the time (microseconds) at which the key's current stretch began.

    A stretch ends at a gap of at least ``gap_seconds``.  Rows are compared only
    within (key, time bucket); what came before a bucket is one summary row per
    bucket, chained per key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    gap = F.lit(int(gap_seconds * MICROS))
    place = [*keys, "_bucket"]
    inside = Window.partitionBy(*place).orderBy("_t")
    timed = df.withColumn("_t", _micros(ts)).withColumn(
        "_bucket", F.floor(F.col("_t") / (bucket_seconds * MICROS)).cast("bigint"))
    # Starts that are visible inside the bucket, i.e. after one of its own rows.
    inner = timed.withColumn("_start", F.when(F.col("_t") - F.lag("_t").over(inside) >= gap, F.col("_t")))
    chain = Window.partitionBy(*keys).orderBy("_bucket")
    buckets = inner.groupBy(*place).agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("_start").alias("_inner"))
    before = F.lag("_last").over(chain)
    opened = buckets.withColumn("_opens", F.when(before.isNull() | (F.col("_first") - before >= gap), F.col("_first")))
    carried = F.last(F.coalesce("_inner", "_opens"), ignorenulls=True).over(
        chain.rowsBetween(Window.unboundedPreceding, -1))
    heads = opened.select(*place, F.coalesce("_opens", carried).alias("_head"))
    own = F.max("_start").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    return inner.withColumn("_own", own).join(heads, place).select(
        *df.columns, F.coalesce("_own", "_head").alias("segment"))


class TokenBucket:
    """State: level and time of the last call.  One token is ``token`` units of level, a microsecond refills ``rate``.

    A rejected call also moves the clock, which changes nothing: the level below one token just goes on growing.
    """

    outputs = "admitted boolean, remaining bigint"
    kinds = (pa.bool_(), pa.int64())

    def __init__(self, rpm: float, burst: int):
        per_micro = Fraction(str(rpm)) / (60 * MICROS)
        self.rate, self.token = per_micro.numerator, per_micro.denominator
        self.full = burst * self.token

    def start(self) -> list[int]:
        return [self.full, 0]

    def step(self, state: list[int], t: int, counts: bool) -> tuple[bool, int]:
        state[0] = min(self.full, state[0] + max(t - state[1], 0) * self.rate)
        state[1] = max(t, state[1])
        admitted = state[0] >= self.token
        if admitted:
            state[0] -= self.token
        return admitted, state[0] // self.token

    def advance(self, state: list[int], times: np.ndarray) -> list[int]:
        i, n = 0, len(times)
        while i < n:
            if self.step(state, int(times[i]), True)[0]:
                i += 1
            else:
                i = int(np.searchsorted(times, state[1] - (state[0] - self.token) // self.rate))
        return state

    def idle(self, state: list[int], now: int) -> bool:
        return state[0] + (now - state[1]) * self.rate >= self.full


class TrailingWindow:
    """State: times of the calls in the window that counted and were not limited, at most ``limit``."""

    outputs = "limited boolean"
    kinds = (pa.bool_(),)

    def __init__(self, limit: int, seconds: int):
        self.limit, self.width = limit, seconds * MICROS

    def start(self) -> deque:
        return deque()

    def step(self, state: deque, t: int, counts: bool) -> tuple[bool]:
        while state and t - state[0] >= self.width:
            state.popleft()
        limited = len(state) >= self.limit
        if counts and not limited:
            state.append(t)
        return (limited,)

    def advance(self, state: deque, times: np.ndarray) -> deque:
        i, n = 0, len(times)
        while i < n:
            if self.step(state, int(times[i]), True)[0]:
                i = int(np.searchsorted(times, state[0] + self.width)) if state else n
            else:
                i += 1
        return state

    def idle(self, state: deque, now: int) -> bool:
        return not state or now - state[-1] >= self.width


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (key, bucket) of a batch: the times of its calls that count, which may be none."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("k")
        code = pc.dictionary_encode(key, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        bucket, t = np.asarray(batch.column("_b")), np.asarray(batch.column("_t"))
        counts = batch.column("counts").fill_null(False).to_numpy(zero_copy_only=False)
        order = np.lexsort((t, bucket, code))
        code, bucket, t, counts = code[order], bucket[order], t[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])]))
        parts = [t[a:b][counts[a:b]].astype(np.int64).tobytes() for a, b in zip(first, [*first[1:], len(t)], strict=True)]
        yield pa.RecordBatch.from_pydict({"k": key.take(pa.array(order[first])), "_b": pa.array(bucket[first], pa.int64()),
                                          "times": pa.array(parts, pa.binary())})


def _chain(limiter, end: bool):
    """The state in which each (key, bucket) begins, from packed times sorted by key and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, place, held, kind = None, (), [], None
        rows: list[tuple] = []

        def ended() -> None:
            nonlocal state, held
            if held:
                state = limiter.advance(state, np.sort(np.concatenate(held)))
                held = []

        def noted(bucket: int) -> None:
            rows.append((place[0], bucket, np.array(state, dtype=np.int64).tobytes()))

        def emitted() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            out = [pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.binary()), strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, ["k", "_b", "state"])

        for batch in batches:
            kind = batch.schema.field("k").type
            for key, bucket, times in zip(*(batch.column(c).to_pylist() for c in ("k", "_b", "times")), strict=True):
                if place == () or key != place[0]:
                    ended()
                    if place != () and end:
                        noted(AFTER)
                    state, place = limiter.start(), (key, None)
                value = np.frombuffer(times, np.int64)
                if bucket == BEFORE:
                    state = type(state)(value.tolist())
                    continue
                if bucket != place[1]:
                    ended()
                    place = (key, bucket)
                    noted(bucket)
                held.append(value)
            if rows:
                yield emitted()
        if place != () and end:
            ended()
            noted(AFTER)
            yield emitted()
    return run


def states(df: DataFrame, key: str, ts: str, limiter, counted: str | None = None, bucket_seconds: int = HOURS,
           before: DataFrame | None = None, end: bool = False) -> DataFrame:
    """``k, _b, state`` of every (key, bucket of time): the state in which it begins.

    ``before`` (``k, state``) are states that keys bring along; with ``end``, a row at AFTER has the one they end in.
    """
    counts = F.lit(True) if counted is None else F.col(counted).cast("boolean")
    kind = df.schema[key].dataType.simpleString()
    t = _micros(ts)
    calls = df.select(F.col(key).alias("k"), t.alias("_t"), F.floor(t / (bucket_seconds * MICROS)).cast("bigint").alias("_b"),
                      counts.alias("counts"))
    packed = calls.mapInArrow(_packed, f"k {kind}, _b bigint, times binary")
    if before is not None:
        packed = packed.unionByName(before.select("k", F.lit(BEFORE).alias("_b"), F.col("state").alias("times")))
    return packed.repartition("k").sortWithinPartitions("k", "_b") \
        .mapInArrow(_chain(limiter, end), f"k {kind}, _b bigint, state binary")


def decide(df: DataFrame, key: str, ts: str, order: list[str], limiter, begun: DataFrame, counted: str | None = None,
           bucket_seconds: int = HOURS) -> DataFrame:
    """Append the limiter's outputs to every call, from the states in which (key, bucket)s begin."""
    own, names = df.columns, [part.split()[0] for part in limiter.outputs.split(", ")]
    counts = F.lit(True) if counted is None else F.col(counted).cast("boolean")
    t = _micros(ts)
    calls = df.select("*", F.col(key).alias("_limit_k"), t.alias("_limit_t"),
                      F.floor(t / (bucket_seconds * MICROS)).cast("bigint").alias("_limit_b"), counts.alias("_limit_counts"))
    heads = begun.filter(F.col("_b") != AFTER).select(F.col("k").alias("_limit_k"), F.col("_b").alias("_limit_b"),
                                                      F.col("state").alias("_limit_state"))
    placed = calls.unionByName(heads, allowMissingColumns=True).repartition("_limit_k", "_limit_b") \
        .sortWithinPartitions("_limit_k", "_limit_b", F.col("_limit_state").isNull(), "_limit_t", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            results: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("_limit_state", "_limit_t", "_limit_counts"))
            for head, time, counts_ in zip(*columns, strict=True):
                if head is not None:
                    state = type(limiter.start())(np.frombuffer(head, np.int64).tolist())
                else:
                    results.append(limiter.step(state, time, bool(counts_)))
            rows = batch.filter(pc.is_null(batch.column("_limit_state")))
            added = [pa.array([r[i] for r in results], kind) for i, kind in enumerate(limiter.kinds)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in own), *added], [*own, *names])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return placed.mapInArrow(run, f"{typed}, {limiter.outputs}")


def token_bucket(
    df: DataFrame, key: str, ts: str, order: list[str], rpm: float = C.BUCKET_RPM, burst: int = C.BUCKET_BURST,
    bucket_seconds: int = HOURS,
) -> DataFrame:
    """Append ``admitted`` and ``remaining`` of a token bucket per key."""
    limiter = TokenBucket(rpm, burst)
    begun = states(df, key, ts, limiter, None, bucket_seconds)
    return decide(df, key, ts, order, limiter, begun, None, bucket_seconds)


def window_admission(
    df: DataFrame, key: str, ts: str, order: list[str], counted: str,
    limit: int = C.AGENT_CALLS, window_seconds: int = C.AGENT_WINDOW_SECONDS, bucket_seconds: int = HOURS,
) -> DataFrame:
    """Append ``limited``: at least ``limit`` counted, unlimited calls in the trailing window.

    Only calls that were not limited themselves and have ``counted`` set enter
    the window.
    """
    limiter = TrailingWindow(limit, window_seconds)
    begun = states(df, key, ts, limiter, counted, bucket_seconds)
    return decide(df, key, ts, order, limiter, begun, counted, bucket_seconds)


def trailing_counts(df: DataFrame, key: str, ts: str, seconds: int, out: str = "recent") -> DataFrame:
    """Append the number of the key's events in the trailing window ``(t - seconds, t]``.

    Keys are cut into time buckets and the last ``seconds`` of a bucket are
    repeated as context for the next one, so a hot key's events are counted by
    many tasks.
    """
    bucket = max(60 * seconds, 3600)
    second = F.floor(_micros(ts) / MICROS).cast("bigint")
    timed = df.withColumn("_t", second).withColumn("_b", F.floor(second / bucket).cast("bigint"))
    edge = F.col("_t") >= (F.col("_b") + 1) * bucket - (seconds - 1)
    places = F.when(edge, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array("_b"))
    copies = timed.select("*", F.explode(places).alias("_place"))
    w = Window.partitionBy(key, "_place").orderBy("_t").rangeBetween(-(seconds - 1), 0)
    return copies.withColumn(out, F.count("*").over(w)).where("_place = _b").select(*df.columns, out)


def over_limit_minutes(df: DataFrame, key: str, ts: str, limit: int) -> DataFrame:
    """Minutes in which a key exceeded the limit."""
    per_minute = df.groupBy(key, F.window(ts, "1 minute").alias("w")).agg(F.count("*").alias("requests"))
    return per_minute.where(F.col("requests") > limit).select(key, F.col("w.start").alias("minute"), "requests")
