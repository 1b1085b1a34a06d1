"""As-of joins against a plain loop, on hot keys, ties, nulls and empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textward.operators.asof import as_of_join

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id long, k string, at timestamp, note string"
STATES = "k string, since timestamp, v string, n long"


def loop(events, states, strict):
    out = []
    for i, k, at, note in events:
        fit = [(s, n, v) for kk, s, v, n in states
               if k is not None and at is not None and kk == k and s is not None and (s < at if strict else s <= at)]
        out.append((i, k, at, note, max(fit, key=lambda x: x[:2])[2] if fit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [3600, 86_400, 10**9])
def test_equal_to_a_loop(spark, strict, bucket):
    rng = random.Random(bucket)
    when = lambda: None if rng.random() < 0.05 else T0 + dt.timedelta(hours=rng.randrange(-30, 400) // 2, minutes=30 * rng.randrange(2))
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    events = [(i // 2, key(), when(), "x" * rng.randrange(3)) for i in range(300)]
    events += events[:5]  # repeated rows
    states = [(key(), when(), f"v{i}", i) for i in range(120)]
    got = as_of_join(spark.createDataFrame(events, EVENTS), spark.createDataFrame(states, STATES),
                     ["k"], "at", "since", ["v"], "n", bucket, strict)
    assert got.columns == ["id", "k", "at", "note", "v"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == loop(events, states, strict)


def test_empty_tables_null_values_and_clashing_names(spark):
    none, some = spark.createDataFrame([], EVENTS), spark.createDataFrame([(1, "a", T0, None)], EVENTS)
    empty = spark.createDataFrame([], STATES)
    assert as_of_join(none, empty, ["k"], "at", "since", ["v"], "n").count() == 0
    assert as_of_join(some, empty, ["k"], "at", "since", ["v"], "n").first()["v"] is None
    # A later state whose value is null is a state: it hides the earlier one.
    states = spark.createDataFrame([("a", T0 - dt.timedelta(days=3), "old", 1), ("a", T0, None, 2)], STATES)
    assert as_of_join(some, states, ["k"], "at", "since", ["v"], "n").first()["v"] is None
    with pytest.raises(ValueError, match="note"):
        as_of_join(some, states.withColumn("note", F.lit("y")), ["k"], "at", "since", ["note"], "n")


def test_a_hot_key_is_dealt_over_tasks(spark):
    span = spark.range(4000).select(
        F.col("id"), F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("at"), F.lit("").alias("note"))
    states = span.select("k", F.col("at").alias("since"), F.col("id").cast("string").alias("v"), F.col("id").alias("n"))
    j = as_of_join(span, states, ["k"], "at", "since", ["v"], "n")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = j.select(F.spark_partition_id().alias("p"), (F.col("v") == F.col("id").cast("string")).alias("right")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len({r.p for r in rows}) > 4 and all(r.right for r in rows) and len(rows) == 4000


def test_vault_entries_valid_when_asked(spark):
    from textward.operators.redact import restore_then
    key = F.lit("0123456789abcdef")
    entry = lambda value, created, hours: ("t", "s", 1, "[EMAIL_001]", value, T0 + dt.timedelta(hours=created), T0 + dt.timedelta(hours=created + hours))
    vault = spark.createDataFrame([entry("first", 0, 10), entry("second", 5, 10)],
                                  "tenant_id string, session_id string, doc_id long, token string, v string, created_at timestamp, expires_at timestamp")
    vault = vault.withColumn("encrypted_value", F.aes_encrypt(F.encode("v", "UTF-8"), key, F.lit("GCM"))).drop("v")
    hours = (-1, 0, 4, 5, 9, 12, 15, None)
    asked = spark.createDataFrame(
        [("t", "s", 1, "to [EMAIL_001].", None if h is None else T0 + dt.timedelta(hours=h)) for h in hours],
        "tenant_id string, session_id string, doc_id long, redacted_text string, asked_at timestamp")
    got = {r.asked_at: r.restored_text for r in restore_then(asked, vault, key).collect()}
    at = lambda h: got[None if h is None else T0 + dt.timedelta(hours=h)]
    assert [at(h) for h in hours] == ["to [EMAIL_001].", "to first.", "to first.", "to second.", "to second.",
                                      "to second.", "to [EMAIL_001].", "to [EMAIL_001]."]


def test_profile_of_the_time_of_the_call(spark):
    from textward.operators.agents import decide
    perms = ["read_files"]
    reg = spark.createDataFrame([("a", T0, 1, perms, "high", "high", False, True), ("a", T0 + dt.timedelta(days=2), 2, perms, "high", "high", False, False)],
                                "agent_id string, registered_at timestamp, registration_id long, permissions array<string>, max_risk string, "
                                "require_approval_above string, sandbox_mode boolean, is_active boolean")
    calls = spark.createDataFrame([(i, "a", T0 + dt.timedelta(days=i), "read_file", "{}") for i in (-1, 1, 3)],
                                  "call_id long, agent_id string, ts timestamp, tool_name string, arguments string")
    got = {r.call_id: (r.decision, r.required_permissions) for r in decide(calls, reg, then=True).collect()}
    assert got[-1][0] == "deny" and got[1] == ("allow", perms) and got[3][0] == "deny"
