"""Streams over several batches: restart, hot reload, keyed limits with bounded state, late rows."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textward.operators import limits as L
from textward.operators import policy as P
from textward.plans.registry import REGISTRY
from textward.streaming import streams as X

T0 = datetime(2024, 1, 1)
CALLS = "event_id long, k long, ts timestamp, counted boolean"


def add_file(spark, folder, rows, schema):
    """One more file of the table, newer than the others."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05)


def calls(seed, n=1500):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 3, 8])
        # Every key falls silent after a while, but for key 0, which a third of all calls use.
        key = 0 if rng.random() < 0.34 else 1 + i // 100 * 3 + rng.randrange(3)
        rows.append((i, key, T0 + timedelta(seconds=t), rng.random() < 0.8))
    return rows


@pytest.mark.parametrize("limiter", [L.TokenBucket(12, 5), L.TrailingWindow(4, 60)])
def test_limits_over_batches_equal_the_batch_result_with_bounded_state(spark, tmp_path, limiter):
    rows, table, out = calls(1), tmp_path / "calls", str(tmp_path / "out")
    for at in range(0, 1500, 300):
        add_file(spark, table, rows[at : at + 300], CALLS)
        if at in (600, 1200):  # the query is started again and goes on
            stream = X.file_stream(spark, str(table), spark.read.parquet(str(table)).schema, 1)
            X.run_available(stream, "limits", writer=X.limit_writer(limiter, "k", "ts", ["event_id"], "counted"), folder=out)
    df = spark.createDataFrame(rows, CALLS)
    counted = "counted"
    whole = L.decide(df, "k", "ts", ["event_id"], limiter, L.states(df, "k", "ts", limiter, counted), counted)
    name = limiter.outputs.split()[0]
    got = {r["event_id"]: r[name] for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {r["event_id"]: r[name] for r in whole.collect()} and len(got) == 1500
    kept = [spark.read.parquet(f"{out}/state/{b}").count() for b in range(5)]
    assert 1 <= max(kept) <= 10 < df.select("k").distinct().count()


def test_a_restart_finds_its_checkpoint(spark, tmp_path):
    table, out = tmp_path / "events", str(tmp_path / "out")
    schema = "doc_id long, text string"
    for part in range(2):
        add_file(spark, table, [(part, "plain words")], schema)
        stream = X.inspect_stream(X.file_stream(spark, str(table), spark.read.parquet(str(table)).schema))
        X.run_available(stream.select("doc_id", "action"), "again", folder=out)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{out}/data").collect()) == [0, 1]


def test_a_stream_reads_its_own_table_only(spark, tmp_path):
    for name in ("t.parquet", "t.parquet.bak", "t.parquet2"):
        add_file(spark, tmp_path / name, [(1, name)], "doc_id long, text string")
    stream = X.file_stream(spark, str(tmp_path / "t.parquet"), spark.read.parquet(str(tmp_path / "t.parquet")).schema)
    out = X.run_available(stream, "own", folder=str(tmp_path / "out"))
    assert [r["text"] for r in spark.read.parquet(f"{out}/data").collect()] == ["t.parquet"]


def test_rules_and_context_are_read_again_for_every_batch(spark, tmp_path):
    table, out = tmp_path / "texts", str(tmp_path / "out")
    schema = "doc_id long, text string"
    rule = P.Rule("p", "P", "x", "1", 1, 0, "secret-word", "n", "block", "high", "e", "r", keywords=("apple",),
                  fields=(("department", ("Sales",)),))
    rules, departments = [rule], {0: "Sales", 1: "Legal", 2: "Sales", 3: "Legal"}
    context = lambda: spark.createDataFrame(list(departments.items()), "doc_id long, department string")
    writer = X.policy_writer(lambda: rules, context, columns=("doc_id", "policy_action"))
    for part in range(2):
        add_file(spark, table, [(2 * part, "an apple"), (2 * part + 1, "an apple and a pear")], schema)
        stream = X.file_stream(spark, str(table), spark.read.parquet(str(table)).schema)
        X.run_available(stream, "rules", writer=writer, folder=out)
        rules[0] = rule._replace(keywords=("pear",), fields=())
    got = {r["doc_id"]: r["policy_action"] for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "block"}


def test_late_rows_are_counted_and_set_aside(spark, tmp_path):
    table = tmp_path / "events"
    schema = "event_id long, ts timestamp, action string"
    minute = lambda m: T0 + timedelta(minutes=m)
    files = [[(1, minute(0), "a"), (2, minute(300), "a")], [(3, minute(5), "a"), (4, minute(299), "a"), (5, minute(600), "a")],
             [(6, minute(10), "a"), (7, minute(20), "a"), (8, minute(601), "a")]]
    for rows in files:
        add_file(spark, table, rows, schema)
    source = lambda: X.file_stream(spark, str(table), spark.read.parquet(str(table)).schema, 1)
    out = X.run_available(source(), "side", writer=X.late_writer("ts", 600), folder=str(tmp_path / "side"))
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{out}/late").collect()) == [3, 6, 7]
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{out}/data").collect()) == [1, 2, 4, 5, 8]
    listener = X.DroppedRows()
    spark.streams.addListener(listener)
    try:
        counted = X.tumbling_counts(source(), "action")
        out = X.run_available(counted, "late_counts", folder=str(tmp_path / "counts"))
        for _ in range(50):
            if listener.dropped.get("late_counts"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped["late_counts"] == 1  # rows 6 and 7, put together before they reach the state
    rows = {(r["window_start"], r["n"]) for r in spark.read.parquet(f"{out}/data").collect()}
    # Row 3 comes before the watermark of its batch is applied; 6 and 7 are dropped.  Closed windows are written once.
    assert {(minute(0), 2), (minute(240), 1), (minute(300), 1)} == rows
    assert spark.read.parquet(f"{out}/data").groupBy("window_start").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event_table(spark, folder):
    """Two files, the second of events hours before the last ones of the first."""
    made = [(i, T0 + timedelta(minutes=7 * i), i % 9, ["error", "view", "other"][i % 3], 300.0 * (i % 2)) for i in range(120)]
    for rows in (made[60:], made[:60]):
        add_file(spark, folder / "events.parquet", rows, EVENTS)
    return made


@pytest.mark.parametrize("files", [1, 1000])
def test_counts_of_all_windows_open_and_late_ones_too(spark, tmp_path, monkeypatch, files):
    made = event_table(spark, tmp_path)
    plain = X.file_stream
    monkeypatch.setattr(X, "file_stream", lambda s, path, schema: plain(s, path, schema, files))
    counts = REGISTRY["stream_action_counts"][0](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in counts) == len(made)
    assert max(r["window_start"] for r in counts) == made[-1][1].strftime("%Y-%m-%d %H:00:00")
    risky = [r for r in made if r[4] > 140]
    windows = REGISTRY["stream_high_risk"][0](spark, str(tmp_path)).collect()
    assert sum(r["high_risk"] for r in windows) == 6 * len(risky)
    assert max(r["window_start"] for r in windows) == risky[-1][1].strftime("%Y-%m-%d %H:00:00")
