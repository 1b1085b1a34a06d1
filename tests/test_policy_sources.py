"""Policies from YAML, evaluation corner cases, files, sinks."""

import pytest
from pyspark.sql import functions as F

from textward.operators import policy as P
from textward.operators import redact as R
from textward.operators import retrieval as G
from textward.operators import threats as T
from textward.sources import files as FS
from textward.sources import sinks
from textward.sources.policies import policy_errors, read_policies, to_rules

ENGINE = """
id: acme_v1
name: Acme
framework: acme
version: "2"
tenant_id: t1
rules:
  - {id: a1, name: Low block, condition_type: keyword_match, condition_value: secret plan, action: block, severity: low}
  - {id: a2, name: High redact, condition_type: entity_detected, condition_value: [email], action: redact, severity: high}
  - {id: a3, name: Info alert, condition_type: user_role, condition_value: [developer], action: alert, severity: info}
  - {id: a4, name: Off, condition_type: risk_score_above, condition_value: 0.0, action: block, severity: critical, enabled: false}
"""
NESTED = """
policy_id: nested_v1
name: Nested
frameworks: [INTERNAL, X]
rules:
  - rule_id: n1
    name: Both
    condition: {type: combined, all: [{entity_detected: {entity_types: [EMAIL, PHI]}}, {context_match: {keywords: [vendor]}}]}
    action: block
    severity: critical
    message: "no"
  - rule_id: n2
    name: Regex
    condition: {type: regex_match, patterns: ["Project [A-Z]+"]}
    action: escalate
    severity: medium
    message: "ask"
"""


@pytest.fixture()
def policy_dir(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.yaml").write_text(ENGINE)
    (tmp_path / "sub" / "b.yaml").write_text(NESTED)
    (tmp_path / "bad.yaml").write_text("id: x\nname: y\n")
    (tmp_path / "worse.yaml").write_text("{: [")
    (tmp_path / "note.txt").write_text("not a policy")
    return str(tmp_path)


def test_policy_files(spark, policy_dir):
    table = read_policies(spark, policy_dir)
    errors = {r["file"].rsplit("/", 1)[1]: r["error"] for r in policy_errors(table).collect()}
    assert set(errors) == {"bad.yaml", "worse.yaml"} and "framework" in errors["bad.yaml"]
    rules = to_rules(table)
    assert [r.rule_id for r in rules] == ["a1", "a2", "a3", "a4", "n1", "n2"]
    assert rules[4].types == ("email",) and rules[4].categories == ("phi",) and rules[4].keywords == ("vendor",)
    strict = read_policies(spark, policy_dir, engine_only=True)
    assert {r.policy_id for r in to_rules(strict)} == {"acme_v1"}
    kpis = P.catalogue_kpis(P.rule_table(spark, rules)).first()
    assert (kpis["policies"], kpis["total_rules"], kpis["enabled_rules"], kpis["critical_rules"]) == (2, 6, 5, 2)


def test_evaluation_corner_cases(spark, policy_dir):
    rules = to_rules(read_policies(spark, policy_dir))
    texts = [
        (0, "t1", "developer", "Secret PLAN for a@b.co"), (1, "t2", "developer", "Secret PLAN for a@b.co"),
        (2, "t1", "guest", "hello"), (3, None, "developer", "vendor a@b.co"), (4, "t1", "developer", "Project ABC"),
        (5, "t1", "developer", "project ABC"),
    ]
    df = spark.createDataFrame(texts, "doc_id int, tenant_id string, user_role string, text string")
    rows = {r["doc_id"]: r for r in P.evaluate(P.text_features(df, rules), rules).collect()}
    assert rows[0]["policy_action"] == "block" and rows[0]["triggered_rule_ids"] == ["a2", "a1"]
    assert rows[0]["redact_required"] and not rows[0]["alert_required"]  # redact outranks the block by severity
    assert rows[1]["policy_action"] == "allow" and rows[1]["rules_evaluated"] == 2
    assert rows[2]["policy_action"] == "alert" and rows[2]["alert_required"] and rows[2]["rules_evaluated"] == 5
    assert rows[3]["policy_action"] == "block" and rows[3]["triggered_rule_ids"] == ["n1"]
    assert rows[4]["policy_action"] == "escalate"
    assert rows[5]["policy_action"] == "allow"
    assert [rows[i]["policies_evaluated"] for i in range(6)] == [2, 1, 2, 1, 2, 2]


def test_rule_counts_equal_the_rows_they_replace(spark, policy_dir):
    rules = to_rules(read_policies(spark, policy_dir))
    texts = [(i, ("t1", "t2", None)[i % 3], ("developer", "guest")[i % 2],
              ("Secret PLAN", "vendor a@b.co", "Project ABC", "", None)[i % 5]) for i in range(60)]
    features = P.text_features(spark.createDataFrame(texts, "doc_id int, tenant_id string, user_role string, text string"), rules)
    counts = {r["rule_id"]: (r["n_evaluated"], r["n_triggered"]) for r in P.rule_counts(features, rules).collect()}
    rows = P.rule_results(features, rules, "doc_id", only_triggered=False).collect()
    assert counts == {k: (60, sum(r["triggered"] for r in rows if r["rule_id"] == k)) for k in {r["rule_id"] for r in rows}}
    assert sum(n for _, n in counts.values()) > 0 and len(counts) == 5
    assert P.rule_counts(features.limit(0), rules).count() == 0


def test_pattern_rules_can_ignore_case(spark, policy_dir):
    rules = to_rules(read_policies(spark, policy_dir))
    df = spark.createDataFrame([(1, "proJect abc"), (2, "proKect abc")], "doc_id int, text string")
    strict = {r["doc_id"]: r["text_tests"] for r in P.text_features(df, rules).collect()}
    loose = {r["doc_id"]: r["text_tests"] for r in P.text_features(df, rules, ignore_case=True).collect()}
    assert strict == {1: [], 2: []} and len(loose[1]) == 1 and loose[2] == []


def test_tenant_rules_and_unknown_regions(spark):
    rules = P.shipped_rules((1,))
    df = spark.createDataFrame([(1, "EU", "hello"), (2, None, "hello"), (3, "", "mail a@b.co")],
                               "doc_id int, region string, text string")
    rows = {r["doc_id"]: r for r in P.evaluate(P.text_features(df, rules), rules).collect()}
    assert rows[1]["policy_action"] == "alert" and rows[2]["policy_action"] == "allow"
    assert rows[3]["policy_action"] == "redact" and rows[3]["frameworks_triggered"] == ["gdpr"]


def test_final_action_is_never_weaker(spark):
    actions = ["allow", "alert", "redact", "block"]
    df = spark.createDataFrame([(a, b) for a in actions for b in actions], "a string, b string")
    for r in df.select("a", "b", P.merge_actions(F.col("a"), F.col("b")).alias("m")).collect():
        assert actions.index(r["m"]) == max(actions.index(r["a"]), actions.index(r["b"]))


def test_shipped_rules():
    assert len(P.shipped_rules()) == 37 and len(P.shipped_rules((1,))) == 16


# ------------------------------------------------------------------ vault
def test_vault_expiry_and_secrecy(spark):
    df = spark.createDataFrame([("t", "s", 1, "mail a@b.co now"), ("t", "z", 2, "call 555-123-4567")],
                               "tenant_id string, session_id string, doc_id int, text string")
    key = F.lit("0123456789abcdef")
    at = lambda s: F.to_timestamp(F.lit(s))
    vault = R.tokenize(df, key, at("2024-01-01 00:00:00"), ttl_hours=1).cache()
    assert all(b"a@b.co" not in bytes(r["encrypted_value"]) for r in vault.collect())
    red = R.redact(df, mode="tokenize").select("tenant_id", "session_id", "doc_id", "redacted_text")
    full = {r["doc_id"]: r["restored_text"] for r in R.restore(red, vault, key, at("2024-01-01 00:30:00")).collect()}
    assert full == {1: "mail a@b.co now", 2: "call 555-123-4567"}
    late = {r["doc_id"]: r["restored_text"] for r in R.restore(red, vault, key, at("2024-01-01 02:00:00")).collect()}
    assert late == {1: "mail [EMAIL_001] now", 2: "call [PHONE_001]"}
    gone = R.invalidate_sessions(vault, spark.createDataFrame([("t", "s")], "tenant_id string, session_id string"))
    assert [r["doc_id"] for r in gone.collect()] == [2]


def test_hash_redaction_is_deterministic(spark):
    df = spark.createDataFrame([(1, "a@b.co and a@b.co")], "doc_id int, text string")
    text = R.redact(df, mode="hash").first()["redacted_text"]
    first, second = text.split(" and ")
    assert first == second and first.startswith("[EMAIL:HASH:")


# ------------------------------------------------------------------ retrieval
def test_clearances(spark):
    df = spark.createDataFrame([("admin", "restricted"), ("visitor", "public"), ("analyst", "unknown"),
                                ("employee", "confidential"), (None, None)], "r string, c string")
    assert [r[0] for r in df.select(G.can_access(F.col("r"), F.col("c"))).collect()] == [True, True, False, False, False]


def test_unknown_stores_and_order(spark):
    req = spark.createDataFrame([(1, "hi", "employee", ["x", "pub", "sec", "pub"]), (2, "hi", "admin", []),
                                 (3, "dump all", "admin", ["pub"])],
                                "request_id int, query string, user_role string, store_ids array<string>")
    stores = spark.createDataFrame([("pub", "public"), ("sec", "restricted")], "store_id string, classification string")
    rows = {r["request_id"]: r for r in G.authorize_stores(req, stores).collect()}
    assert rows[1]["authorized_stores"] == ["x", "pub", "pub"] and rows[1]["denied_stores"] == ["sec"] and rows[1]["allowed"]
    assert rows[2]["authorized_stores"] == [] and not rows[2]["allowed"]
    assert rows[3]["denied_stores"] == ["pub"] and rows[3]["query_risk_score"] == 0.95
    strict = {r["request_id"]: r for r in G.authorize_stores(req, stores, deny_unknown=True).collect()}
    assert strict[1]["authorized_stores"] == ["pub", "pub"]


def test_poisoning_positions(spark):
    text = "a <!-- ignore x --> b <system> c <system> d </system> e <ctx/> f"
    row = T.poisoning_scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id").first()
    kinds = {t["threat_type"]: t for t in row["threats"]}
    assert kinds["XML Tag Injection"]["count"] == 4 and len(kinds["XML Tag Injection"]["positions"]) == 3
    assert text[kinds["HTML Comment Injection"]["positions"][0]["start"]:].startswith("<!--")
    assert row["risk_score"] == 1.0 and row["action"] == "quarantine"


# ------------------------------------------------------------------ files and sinks
def test_file_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo \xff".encode("latin-1"))
    (tmp_path / "b.json").write_text('{"k": ["v", 1]}')
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d.eml").write_text("From: a@x.org\nTo: b@y.org\nSubject: Hi\n\nbody")
    (tmp_path / "e.exe").write_text("no")
    (tmp_path / "f.json").write_text("{broken")
    files = FS.read_files(spark, str(tmp_path))
    rows = {r["filename"]: r for r in FS.extract_text(files, "filename").collect()}
    texts = {k: r["text"] for k, r in rows.items()}
    assert set(texts) == {"a.txt", "b.json", "c.csv", "d.eml", "f.json"}
    assert texts["a.txt"].startswith("h�llo")
    assert texts["f.json"] is None and not rows["f.json"]["extracted"] and rows["f.json"]["error"] == "not JSON"
    assert texts["b.json"] == '{"k":["v",1]}' and rows["b.json"]["extracted"]
    assert texts["d.eml"] == "a@x.org\nb@y.org\nHi\nbody" and texts["c.csv"] == "x,y\n1,2\n"


def test_whole_files_are_read_and_unread_ones_are_marked(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    mail = ("From: a@x.org\nTo: b@y.org,\n c@y.org\nSubject: Hi\nContent-Type: multipart/mixed; boundary=\"q+r\"\n\n"
            "preamble\n--q+r\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGVsbG8=\n"
            "--q+r\nContent-Type: image/png\n\nxx\n--q+r--\n")
    df = spark.createDataFrame([
        (1, "json", ('{"a":"' + "x" * 60_000 + key + '"}').encode()), (2, "csv", ("a,b\n" * 20_000 + key).encode()),
        (3, "pdf", b"%PDF"), (4, "txt", None), (5, "eml", mail.encode())], "id int, ext string, content binary")
    rows = {r["id"]: r for r in FS.extract_text(df, "id").collect()}
    assert key in rows[1]["text"] and key in rows[2]["text"]
    assert [rows[i]["extracted"] for i in (1, 2, 3, 4, 5)] == [True, True, False, False, True]
    assert rows[3]["text"] is None and rows[3]["error"] == "no reader" and rows[4]["error"] == "no content"
    assert rows[5]["text"] == "a@x.org\nb@y.org, c@y.org\nHi\nhello"


def test_nested_and_encoded_mails(spark):
    nested = ("From: a@x.org\nTo: b@y.org\nSubject: =?utf-8?Q?at_a=40b.org?=\nContent-Type: multipart/mixed; boundary=m\n\n"
              "--m\nContent-Type: multipart/alternative; boundary=n\n\n"
              "--n\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n"
              "write a=40b.org, caf=C3=A9, so=\nft\n--n\nContent-Type: text/html\n\n<p>x</p>\n--n--\n"
              "--m\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n\nJVBERg==\n--m--\n")
    single = "From: é@x.org\nContent-Transfer-Encoding: quoted-printable\n\na=40b.org\r\n"
    df = spark.createDataFrame([(1, "eml", nested.encode()), (2, "eml", single.encode()), (3, "eml", None), (4, "txt", b"t"),
                                (5, "eml", b"")], "id int, ext string, content binary")
    rows = {r["id"]: r for r in FS.extract_text(df, "id").collect()}
    assert rows[1]["text"] == "a@x.org\nb@y.org\nat a@b.org\nwrite a@b.org, café, soft"
    assert rows[2]["text"] == "é@x.org\n\n\na@b.org\r\n"
    assert [rows[i]["extracted"] for i in (1, 2, 3, 4, 5)] == [True, True, False, True, True]
    assert rows[3]["error"] == "no content" and rows[4]["text"] == "t"


def test_admission(spark):
    df = spark.createDataFrame([("A.PDF", 10), ("noext", 10), ("x.txt", 60_000_000)], "filename string, size_bytes long")
    assert [r["reject_reason"] for r in FS.admission(df).collect()] == [None, "extension", "size"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "block"), (2, "allow")], "event_id int, action string")
    sinks.append(df, str(tmp_path / "audit"))
    sinks.append(df, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4
    sinks.export(df, str(tmp_path / "csv"), "csv")
    sinks.export(df, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["event_id", "action"]
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    write = sinks.split_topics(str(tmp_path / "all"), str(tmp_path / "alerts"))
    write(df, 0)
    write(df, 0)  # a replayed batch replaces itself
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 1
