"""Conversation history: truncation, bounds, context windows, session lifecycle.

Messages are rows ``(tenant_id, session_id, turn, role, content)``.  A session may
hold a large share of all messages, so nothing here ranks or collects a whole
session: per-session limits are found on narrow rows by a salted two-step rank
that keeps at most ``limit`` rows per salt, and texts are joined only to the
per-session or per-message result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from .limits import activity_segments
from .threats import memory_poison

SESSION = ("tenant_id", "session_id")
SALTS = 32


def truncate_messages(df: DataFrame, content: str = "content", limit: int = C.MAX_MESSAGE_CHARS) -> DataFrame:
    c = F.col(content)
    cut = F.concat(F.left(c, F.lit(limit)), F.lit(C.MESSAGE_CUT_MARK))
    return df.withColumn(content, F.when(F.length(c) > limit, cut).otherwise(c))


def _salt(order: str) -> Column:
    return F.pmod(F.xxhash64(order), F.lit(SALTS))


def extreme_rows(df: DataFrame, keys, order: str, limit: int, newest: bool = True) -> DataFrame:
    """The ``limit`` newest (or oldest) rows per key with their ``rank``.

    The first rank runs per (key, salt), where Spark also limits groups before
    the shuffle; the second sees at most ``SALTS * limit`` rows of a key.
    """
    by = F.col(order).desc() if newest else F.col(order).asc()
    first = df.withColumn("_salt", _salt(order)).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(by))
    ).where(F.col("rank") <= limit).drop("_salt", "rank")
    return first.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    ).where(F.col("rank") <= limit)


def history_bounds(messages: DataFrame, keys=SESSION, limit: int = C.MAX_HISTORY_MESSAGES) -> DataFrame:
    """Sessions over the limit with the first non-system turn they keep (null keeps all of them).

    ``limit - n_system`` newest others are kept; with exactly ``limit`` system
    messages all others stay, and with more the first ``n_system - limit`` others go.
    """
    system = F.col("role") == "system"
    over = messages.groupBy(*keys).agg(
        F.count("*").alias("_total"), F.count_if(system).alias("_system")
    ).where(F.col("_total") > limit).select(*keys, (F.lit(limit) - F.col("_system")).alias("_keep"))
    others = messages.where(~system).select(*keys, "turn")
    usual = others.join(over.where("_keep > 0"), list(keys))
    kept = extreme_rows(usual, keys, "turn", limit).where("rank <= _keep").groupBy(*keys).agg(
        F.min("turn").alias("first_turn"))
    # More system messages than the limit: count others from the oldest, in salted steps.
    crowded = others.join(over.where("_keep < 0"), list(keys)).withColumn("_salt", _salt("turn"))
    inner = crowded.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("turn")))
    ranked = inner.where("_r <= -_keep").withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy("turn")))
    dropped = ranked.where("_r <= -_keep").groupBy(*keys).agg((F.max("turn") + 1).alias("first_turn"))
    return over.select(*keys).join(kept.unionByName(dropped), list(keys), "left")


def bound_history(messages: DataFrame, keys=SESSION, limit: int = C.MAX_HISTORY_MESSAGES) -> DataFrame:
    """Messages that survive the history limit; system messages always do.

    Only sessions over the limit are on the joined side.
    """
    bounds = history_bounds(messages, keys, limit).withColumn("_over", F.lit(True))
    joined = messages.join(bounds, list(keys), "left")
    keep = (F.col("role") == "system") | F.col("first_turn").isNull() | (F.col("turn") >= F.col("first_turn"))
    return joined.where(keep).select(*messages.columns)


def assemble(messages: DataFrame, keys=SESSION, system_prompt: str | None = None) -> DataFrame:
    """One text per session: non-system contents in order, newline-joined.

    Meant for bounded histories (see :func:`bound_history`).
    """
    spoken = F.when(F.col("role") != "system", F.struct("turn", "content"))
    grouped = messages.groupBy(*keys).agg(F.array_sort(F.collect_list(spoken)).alias("_m"))
    text = F.array_join(F.transform("_m", lambda m: m["content"]), "\n")
    if system_prompt:
        text = F.concat(F.lit(system_prompt + "\n"), text)
    return grouped.select(*keys, text.alias("text"))


# ------------------------------------------------------------------ context window
def context_features(messages: DataFrame, keys=SESSION) -> DataFrame:
    """Length and poison flag per message; the only step that reads contents."""
    return messages.select(
        *keys, "turn", F.length("content").alias("chars"), memory_poison(F.col("content")).alias("poisoned"))


def context_stops(
    features: DataFrame, keys=SESSION, max_messages: int = C.CONTEXT_MESSAGES,
    max_chars: int = C.CONTEXT_CHARS, system_chars: int = 0,
) -> DataFrame:
    """Per session: kept turns, and the turn at which the walk stopped with its reason.

    Walking from the newest message, the walk stops before a message when enough
    are kept or its length would exceed the limit; poisoned messages are skipped
    but can stop the walk as well.  At most ``max_messages + 1`` clean messages
    per session can matter, so only those are collected.
    """
    clean = extreme_rows(features.where(~F.col("poisoned")), keys, "turn", max_messages + 1)
    recent = clean.groupBy(*keys).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("turn", "chars")))).alias("recent"))
    # before: characters of all newer clean messages; position: how many there are.
    seen = F.aggregate(
        F.transform("recent", lambda m, i: F.struct(m["turn"].alias("turn"), m["chars"].alias("chars"), i.alias("i"))),
        F.struct(F.lit(system_chars).cast("bigint").alias("sum"),
                 F.array().cast("array<struct<turn:bigint,chars:int,i:int,before:bigint>>").alias("out")),
        lambda acc, m: F.struct(
            (acc["sum"] + m["chars"]).alias("sum"),
            F.concat(acc["out"], F.array(F.struct(
                m["turn"].cast("bigint").alias("turn"), m["chars"].alias("chars"), m["i"].alias("i"),
                acc["sum"].alias("before")))).alias("out")),
        lambda acc: acc["out"])
    walked = recent.select(*keys, seen.alias("recent"))

    def stops(position: Column, before: Column, chars: Column) -> Column:
        return F.when(position >= max_messages, "messages").when(before + chars > max_chars, "chars")

    clean_stop = F.get(F.filter(
        F.transform("recent", lambda m: F.struct(m["turn"].alias("turn"), stops(m["i"], m["before"], m["chars"]).alias("why"))),
        lambda s: s["why"].isNotNull()), F.lit(0))
    poisoned = features.where("poisoned").select(*keys, "turn", "chars").join(walked, list(keys), "left")
    newer = F.filter(F.coalesce("recent", F.array().cast("array<struct<turn:bigint,chars:int,i:int,before:bigint>>")),
                     lambda m: m["turn"] > F.col("turn"))
    last = F.try_element_at(newer, F.lit(-1))
    position = F.size(newer)
    before = F.coalesce(last["before"] + last["chars"], F.lit(system_chars).cast("bigint"))
    poison_stop = poisoned.select(
        *keys, F.col("turn").cast("bigint").alias("turn"), stops(position, before, F.col("chars")).alias("why"),
    ).where("why IS NOT NULL").groupBy(*keys).agg(F.max(F.struct("turn", "why")).alias("_p"))
    everyone = features.groupBy(*keys).agg(F.count("*").alias("messages"))
    joined = everyone.join(walked.withColumn("_c", clean_stop), list(keys), "left").join(poison_stop, list(keys), "left")
    stop = F.greatest("_c", "_p")
    kept = F.transform(
        F.filter(F.coalesce("recent", F.array().cast("array<struct<turn:bigint,chars:int,i:int,before:bigint>>")),
                 lambda m: stop.isNull() | (m["turn"] > stop["turn"])),
        lambda m: m["turn"])
    return joined.select(*keys, "messages", kept.alias("kept_turns"),
                         stop["turn"].alias("stop_turn"), stop["why"].alias("stop_reason"))


def trim_context(messages: DataFrame, stops: DataFrame, keys=SESSION) -> DataFrame:
    """The messages that go to the model, joined by (session, turn), which no session can skew."""
    kept = stops.select(*keys, F.explode("kept_turns").alias("turn"))
    return messages.join(kept, [*keys, "turn"], "left_semi")


def trim_warnings(
    features: DataFrame, stops: DataFrame, keys=SESSION, max_messages: int = C.CONTEXT_MESSAGES
) -> DataFrame:
    """One row per warning; ``turn`` orders them, newest first."""
    reason = F.when(
        F.col("stop_reason") == "messages", F.lit(f"Message history truncated at {max_messages} messages")
    ).otherwise("Message history truncated due to context window limit")
    cut = stops.where("stop_turn IS NOT NULL").select(*keys, F.col("stop_turn").alias("turn"), reason.alias("warning"))
    poisoned = features.where("poisoned").join(stops.select(*keys, "stop_turn"), list(keys)).where(
        F.col("stop_turn").isNull() | (F.col("turn") > F.col("stop_turn")))
    message_id = F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn").cast("string"))
    removed = poisoned.select(*keys, F.col("turn").cast("bigint").alias("turn"), F.concat(
        F.lit("Poisoned message detected and removed: message_id="), message_id).alias("warning"))
    return cut.unionByName(removed)


# ------------------------------------------------------------------ lifecycle
def session_metadata(events: DataFrame, keys=SESSION, ts: str = "ts", risk: str = "risk_score") -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("message_count"), F.max(risk).alias("max_risk_score"),
        F.min(ts).alias("created_at"), F.max(ts).alias("last_active_at"))


def split_expired(metadata: DataFrame, as_of: Column, ttl_seconds: int = C.SESSION_TTL_SECONDS) -> DataFrame:
    """Append ``expired``: the session's time to live after its last write has passed."""
    expiry = F.col("last_active_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return metadata.withColumn("expired", expiry < as_of)


def activity_windows(events: DataFrame, keys=SESSION, ts: str = "ts", ttl_seconds: int = C.SESSION_TTL_SECONDS) -> DataFrame:
    """Stretches of activity that a session's time to live would keep alive.

    Stretches are found per time bucket and counted with map-side combination,
    so a very active session is not merged in one task.
    """
    cut = activity_segments(events.select(*keys, ts), keys, ts, ttl_seconds)
    width = F.make_dt_interval(secs=F.lit(ttl_seconds))
    return cut.groupBy(*keys, "segment").agg(
        F.min(ts).alias("started_at"), (F.max(ts) + width).alias("expires_at"), F.count("*").alias("messages")
    ).drop("segment")


def erase_sessions(messages: DataFrame, sessions: DataFrame, keys=SESSION) -> DataFrame:
    return messages.join(sessions.select(*keys), list(keys), "left_anti")


def flag_sessions(metadata: DataFrame, flags: DataFrame, keys=SESSION) -> DataFrame:
    """Append ``is_flagged`` and ``flag_reason``; the last flag of a session wins."""
    latest = flags.groupBy(*keys).agg(F.max_by("reason", "flagged_at").alias("flag_reason"))
    return metadata.join(latest, list(keys), "left").withColumn("is_flagged", F.col("flag_reason").isNotNull())


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")
