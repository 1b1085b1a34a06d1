"""The engine over unbounded inputs: Structured Streaming versions of the operators.

Stateless operators (inspection, policies) are the batch functions applied to a
streaming DataFrame.  Windows, sessions and replays carry a watermark, so in append
mode their state is bounded by the allowed lateness instead of by the length of the
stream; counts of all windows, open ones and late rows included, need complete mode.
Rate limits run the batch operator on every micro-batch, from the states that the
one before has written; a state that says nothing any more is not written again.

Whatever ``foreachBatch`` writes goes to a folder named by the batch, so a batch
that is run again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions import catalog as C
from ..operators import inspect as I
from ..operators import limits as L
from ..operators import policy as P


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name in the shared directory the cluster names; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='textward-')}/{name}"


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table, one file or a folder of part files, as a stream; ``files_per_trigger`` bounds a micro-batch."""
    path = path.rstrip("/")
    exactly = f"{path[:-1]}[{path[-1]}]"  # a pattern, as the source takes no single file; it fits this name alone
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(exactly)


def inspect_stream(texts: DataFrame, text: str = "text") -> DataFrame:
    return I.verdicts(texts, text)


def policy_writer(rules: Callable[[], Sequence[P.Rule]], context: Callable[[], DataFrame] | None = None,
                  key: str = "doc_id", text: str = "text", columns: Sequence[str] = ("*",)) -> Callable:
    """Policy decisions of each micro-batch, by the rules and the request context as they are when it begins.

    ``rules`` reads the rules again for every batch (hot reload); ``context`` reads the table that is joined by ``key``.
    """
    def writer(out: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, batch_id: int) -> None:
            now = list(rules())
            features = P.text_features(batch, now, text)
            if context is not None:
                features = features.join(context(), key, "left")
            P.evaluate(features, now).select(*columns).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

        return write

    return writer


def tumbling_counts(events: DataFrame, *labels: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per window and label; late rows beyond the watermark are dropped and counted by Spark."""
    w = F.window("ts", width).alias("w")
    counted = events.withWatermark("ts", lateness).groupBy(w, *labels).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *labels, "n")


def sliding_high_risk(
    events: DataFrame, threshold: float = 0.7, width: str = "10 minutes", step: str = "1 minute", lateness: str = "10 minutes",
) -> DataFrame:
    risky = events.where(F.col("risk_score") > threshold).withWatermark("ts", lateness)
    counted = risky.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("high_risk"))
    return counted.select(F.col("w.start").alias("window_start"), "high_risk")


def session_activity(events: DataFrame, *keys: str, ttl_seconds: int = C.SESSION_TTL_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Session metadata, emitted once a session has expired.

    Spark closes a session at its expiry instant; an event exactly then opens a new one.
    """
    w = F.session_window("ts", f"{ttl_seconds} seconds").alias("w")
    grouped = events.withWatermark("ts", lateness).groupBy(*keys, w).agg(
        F.count("*").alias("messages"), F.max("risk_score").alias("max_risk_score"))
    return grouped.select(*keys, F.col("w.start").alias("started_at"), F.col("w.end").alias("expires_at"),
                          "messages", "max_risk_score")


def without_replays(events: DataFrame, *fingerprint: str, lateness: str = "1 hour") -> DataFrame:
    """Drop events whose fingerprint was seen within the lateness; state expires with the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(fingerprint))


def limit_writer(limiter, key: str, ts: str, order: Sequence[str], counted: str | None = None) -> Callable:
    """The limiter's decisions on each micro-batch (``operators.limits``), in order of time within the batch.

    States are kept per key in ``state/<batch>``, those of idle keys (a full bucket, an empty window at the latest
    time seen) left out, so they are as many as keys were active lately.
    """
    def writer(out: str) -> Callable[[DataFrame, int], None]:
        def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                kept = []
                for state, now in zip(*(rows.column(c).to_pylist() for c in ("state", "now")), strict=True):
                    held = type(limiter.start())(np.frombuffer(state, np.int64).tolist())
                    kept.append(not limiter.idle(held, now))
                yield rows.filter(pa.array(kept, pa.bool_()))

        def write(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            kind = batch.schema[key].dataType.simpleString()
            before = spark.read.parquet(f"{out}/state/{batch_id - 1}") if batch_id else None
            begun = L.states(batch, key, ts, limiter, counted, before=None if before is None else before.select("k", "state"),
                             end=True)
            begun.write.mode("overwrite").parquet(f"{out}/begun/{batch_id}")
            begun = spark.read.parquet(f"{out}/begun/{batch_id}")
            L.decide(batch, key, ts, list(order), limiter, begun, counted) \
                .write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")
            latest = batch.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()[0]
            if before is not None:
                latest = max(filter(None, (latest, before.agg(F.max("now")).first()[0])), default=None)
            begun.filter(F.col("_b") == L.AFTER).select("k", "state", F.lit(latest or 0).cast("bigint").alias("now")) \
                .mapInArrow(active, f"k {kind}, state binary, now bigint") \
                .write.mode("overwrite").parquet(f"{out}/state/{batch_id}")

        return write

    return writer


def late_writer(ts: str, lateness_seconds: int) -> Callable:
    """Rows in time to ``data``, and late ones to ``late``, both by batch.

    A row is late if it is older, by more than the lateness, than the latest row of the batches before its own.
    """
    def writer(out: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, batch_id: int) -> None:
            spark, time = batch.sparkSession, F.unix_micros(F.col(ts).cast("timestamp"))
            seen = spark.read.parquet(f"{out}/latest/{batch_id - 1}").first()["latest"] if batch_id else None
            late = F.coalesce(time < F.lit(seen).cast("bigint") - lateness_seconds * 1_000_000, F.lit(False))
            batch.filter(~late).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")
            batch.filter(late).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
            batch.agg(F.greatest(F.max(time), F.lit(seen).cast("bigint")).alias("latest")) \
                .write.mode("overwrite").parquet(f"{out}/latest/{batch_id}")

        return write

    return writer


class DroppedRows(StreamingQueryListener):
    """Counts, by query name, the rows that stateful operators dropped because they were behind the watermark.

    An aggregation combines rows before its state sees them, so equal ones may count as one; ``late_writer`` keeps each.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        self.dropped[event.progress.name] = self.dropped.get(event.progress.name, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def whole_writer(out: str) -> Callable[[DataFrame, int], None]:
    """The whole result so far in place of the one before, as ``complete`` mode gives it: every window, open ones too."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data")

    return write


def run_available(stream: DataFrame, name: str, mode: str = "append", writer=None, folder: str | None = None) -> str:
    """Process what is available and stop; returns the output folder.

    Results and the query's checkpoint go to ``folder``; a query that is started again with the same folder goes on
    where it stopped.  Without one, a new folder in the shared directory is taken.  In ``complete`` mode, which drops no
    late rows and keeps every group as state, ``data`` is the whole result; otherwise batches add to it.
    """
    out = folder or shared_folder(stream.sparkSession, f"{name}-{uuid.uuid4().hex}")
    if mode == "complete" and writer is None:
        writer = whole_writer
    sink = stream.writeStream.queryName(name).outputMode(mode) \
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    sink = sink.format("parquet").option("path", f"{out}/data") if writer is None else sink.foreachBatch(writer(out))
    query = sink.start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return out
