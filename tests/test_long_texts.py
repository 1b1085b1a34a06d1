"""Texts with thousands of hits: positions, tokens and pieces against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from textward.functions.splice import CHUNK, chunks, merged, piece, redaction
from textward.operators.redact import redact, redact_to_vault, restore

HITS = "array<struct<det:int,start:int,end:int,value:string>>"


def test_thousands_of_hits_in_one_text(spark):
    n = 3_000
    text = " ".join(f"é\U0001F600 user{i}@mail.com x" for i in range(n))
    want = " ".join(f"é\U0001F600 [EMAIL_{n - i:03d}] x" for i in range(n))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    for overlaps in ("merge", "splice"):
        row = redact(df, overlaps=overlaps).first()
        assert row.redacted_text == want and row.redaction_count == n


def test_pieces_across_chunks(spark):
    text = "".join(chr(random.Random(5).randrange(32, 300)) + ("\U0001F600" if i % 7 == 0 else "\n") for i in range(2_000))
    cuts = [(0, 0), (0, 1), (0, CHUNK), (CHUNK - 1, CHUNK + 1), (CHUNK, 2 * CHUNK), (3, 4 * CHUNK + 5),
            (10, len(text)), (len(text), len(text)), (len(text) - 1, len(text) + 9), (9, 4)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a int, b int")
    got = df.select("a", "b", piece(chunks(F.col("text")), F.col("a"), F.col("b")).alias("p")).collect()
    assert {(r.a, r.b): r.p for r in got} == {(a, b): text[a:b] for a, b in cuts}


def test_overlapping_hits_are_united_beyond_one_block(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefg ") for _ in range(9_000))
    spans = sorted({(a := rng.randrange(8_900), a + rng.randrange(1, 9)) for _ in range(1_500)})
    unions: list[list[int]] = []
    for a, b in spans:
        if unions and a < unions[-1][1]:
            unions[-1][1] = max(unions[-1][1], b)
        else:
            unions.append([a, b])
    df = spark.createDataFrame([(text, [(0, a, b, text[a:b]) for a, b in spans])], f"text string, hits {HITS}")
    one = df.select("text", merged(F.col("hits"), F.col("text")).alias("hits"))
    row = one.select("hits", redaction(F.col("text"), F.col("hits"))["text"].alias("done")).first()
    assert [[h.start, h.end] for h in row.hits] == unions
    assert all(h.value == text[h.start:h.end] for h in row.hits)
    label = row.done.split("[")[1].rsplit("_", 1)[0]
    want, at = "", 0
    for i, (a, b) in enumerate(unions):
        want += text[at:a] + f"[{label}_{len(unions) - i:03d}]"
        at = b
    assert row.done == want + text[at:]


def test_no_hits_and_null_text(spark):
    df = spark.createDataFrame([("plain", []), (None, []), ("", [])], f"text string, hits {HITS}")
    got = df.select(redaction(F.col("text"), merged(F.col("hits"), F.col("text")))["text"].alias("t")).collect()
    assert [r.t for r in got] == ["plain", None, ""]


def _spliced_by_hand(text: str, spans: list[tuple[int, int]], label: str) -> str:
    """Tokens over original offsets, from the last span to the first; ties keep their order."""
    for n, (a, b) in enumerate(sorted(spans, key=lambda s: -s[0]), 1):
        text = text[:a] + f"[{label}_{n:03d}]" + text[b:]
    return text


def test_overlapping_hits_are_spliced_as_by_hand(spark):
    rng = random.Random(4)
    rows = []
    for n, longest, size in ((3, 9, 60), (40, 30, 400), (1_500, 12, 20_000), (900, 9_000, 30_000), (400, 3, 500)):
        text = "".join(rng.choice("abcdé\U0001F600 ") for _ in range(size))
        spans = [(a := rng.randrange(size - 1), min(size, a + rng.randrange(1, longest + 1))) for _ in range(n)]
        spans = list(dict(spans).items())  # one hit for each start
        rows.append((text, [(0, a, b, text[a:b]) for a, b in spans]))
    df = spark.createDataFrame(rows, f"text string, hits {HITS}")
    for r in df.select("text", "hits", redaction(F.col("text"), F.col("hits")).alias("r")).collect():
        label = r.r.records[0].token[1:].rsplit("_", 1)[0]
        assert r.r.text == _spliced_by_hand(r.text, [(h.start, h.end) for h in r.hits], label)
        assert [x.start for x in r.r.records] == sorted((h.start for h in r.hits), reverse=True)
        assert all(x.value == r.text[x.start:x.end] for x in r.r.records)


def test_thousands_of_tokens_are_restored_in_one_pass(spark):
    n = 6_000
    when, key = F.to_timestamp(F.lit("2024-06-01 00:00:00")), F.lit("0123456789abcdef")
    text = " ".join(f"é user{i}@mail.com [EMAIL_99999] [x" for i in range(n))
    docs = spark.createDataFrame([("t", "s", 1, text), ("t", "s", 2, "plain [EMAIL_001]"), ("t", "s", 3, None)],
                                 "tenant_id string, session_id string, doc_id long, text string")
    redacted, vault = redact_to_vault(docs, key, when)
    assert vault.count() == n
    late = {r.doc_id: r.restored_text for r in restore(redacted, vault, key, F.lit("2030-01-01").cast("timestamp")).collect()}
    assert "user1@" not in late[1] and f"[EMAIL_{n}]" in late[1]
    back = restore(redacted, vault, key, when)
    assert {r.doc_id: r.restored_text for r in back.collect()} == {1: text, 2: "plain [EMAIL_001]", 3: None}


def test_vaulting_and_restoring_read_the_texts_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(20).selectExpr("'t' AS tenant_id", "'s' AS session_id", "id AS doc_id",
                               "concat('mail a', id, '@b.org') AS text").write.parquet(path)
    when, key = F.to_timestamp(F.lit("2024-06-01 00:00:00")), F.lit("0123456789abcdef")
    back = restore(*redact_to_vault(spark.read.parquet(path), key, when), key, when)
    assert back.where("restored_text = concat('mail a', doc_id, '@b.org')").count() == 20
    back.collect()
    plan = back._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan") == 1
