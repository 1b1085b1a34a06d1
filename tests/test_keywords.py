"""Keyword rules of many tenants against a plain loop."""

import random

import pytest

from textward.operators import keywords as K

RULES = "rule_id string, tenant_id string, keyword string, action string"
TEXTS = "doc_id long, tenant_id string, text string"


def model(texts, rules):
    out = {}
    for i, tenant, text in texts:
        hits = sorted({(r, a) for r, owner, word, a in rules
                       if word and text and owner in (None, tenant) and word.lower() in text.lower()})
        actions = {a for _, a in hits}
        out[i] = (hits, next((a for a in K.ACTIONS if a in actions), "allow"))
    return out


def evaluated(spark, texts, rules):
    out = K.keyword_rules(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(rules, RULES))
    return {r["doc_id"]: ([tuple(f) for f in r["fired"]], r["keyword_action"]) for r in out.collect()}


def random_case(rules, texts, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcDE") for _ in range(rng.randint(1, 6)))
    made = [(f"r{i}", rng.choice([None, "t1", "t2", f"t{i % 500}"]), word(), rng.choice([*K.ACTIONS, "other"]))
            for i in range(rules)]
    made += [("none", None, None, "block"), ("none", None, "", "block"), ("r0", None, "zzz", "alert"), ("r1", "t1", "İß", "alert")]
    rows = [(i, rng.choice([None, "t1", "t2", f"t{i}"]), " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(texts)]
    return [*rows, (-1, "t1", None), (-2, "t1", ""), (-3, "t1", "x " * 50_000 + "zzz"), (-4, "t1", "an İß")], made


@pytest.mark.parametrize("most", [200_000, 37])
def test_keyword_rules_equal_a_plain_loop(spark, monkeypatch, most):
    monkeypatch.setattr(K, "MOST_KEYWORDS", most)
    texts, rules = random_case(100, 120)
    assert evaluated(spark, texts, rules) == model(texts, rules)


def test_ten_thousand_rules_leave_the_plan_as_it_is(spark):
    texts, rules = random_case(10_000, 60)
    assert evaluated(spark, texts, rules) == model(texts, rules)
    sizes = [len(K.keyword_rules(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(rules[:n], RULES))
                 ._jdf.queryExecution().executedPlan().toString()) for n in (10, 10_000)]
    assert abs(sizes[0] - sizes[1]) < 100


def test_without_rules_or_texts(spark):
    assert evaluated(spark, [(1, "t", "a")], []) == {1: ([], "allow")}
    assert evaluated(spark, [], [("r", None, "a", "block")]) == {}


def test_fired_rules_are_told_apart_and_sorted_by_number_not_by_comparing_structs(spark):
    texts = [(1, "t1", "ab c d"), (2, None, "ab c d"), (3, "t2", "A"), (4, "t1", None)]
    rules = [(f"r{i}", owner, word, "alert") for i in range(2_000) for owner, word in (("t1", "B"), (None, "b c"), (None, "a"))]
    out = K.keyword_rules(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(rules, RULES))
    assert evaluated(spark, texts, rules) == model(texts, rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" not in plan and "array_sort" not in plan  # the first is quadratic on structs


def test_null_ids_and_actions_come_first(spark):
    rules = [("b", None, "a", None), (None, None, "a", "redact"), ("b", None, "a", "block"), ("a", "t1", "a", "alert")]
    out = K.keyword_rules(spark.createDataFrame([(1, "t1", "a")], TEXTS), spark.createDataFrame(rules, RULES)).first()
    assert [tuple(f) for f in out["fired"]] == [(None, "redact"), ("a", "alert"), ("b", None), ("b", "block")]
    assert out["keyword_action"] == "block"
