"""Policy files: YAML in either schema, parsed where the files are read."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rulebook import (
    ACTIONS, CONDITION_TYPES, DEFAULT_REMEDIATION, REQUIRED_POLICY_KEYS, REQUIRED_RULE_KEYS,
)
from ..operators.policy import Rule, condition_label, condition_parts

ROW = ("file string, policy_id string, policy_name string, framework string, version string, schema_version int, "
       "rule_ord int, rule_id string, name string, condition string, action string, severity string, "
       "explanation string, remediation string, enabled boolean, active boolean, tenant_id string, error string")
_COLUMNS = [part.split()[0] for part in ROW.split(", ")]


def _schema_one(raw: dict) -> list[dict]:
    missing = sorted(set(REQUIRED_POLICY_KEYS) - set(raw))
    if missing:
        raise ValueError(f"missing required fields: {missing}")
    out = []
    for i, r in enumerate(raw["rules"] or ()):
        missing = sorted(set(REQUIRED_RULE_KEYS) - set(r))
        if missing:
            raise ValueError(f"rule[{i}] missing: {missing}")
        if r["condition_type"] not in CONDITION_TYPES or r["action"] not in ACTIONS:
            raise ValueError(f"rule[{i}] has an unknown condition type or action")
        out.append({
            "policy_id": raw["id"], "policy_name": raw["name"], "framework": raw["framework"],
            "version": str(raw["version"]), "schema_version": 1, "rule_ord": i, "rule_id": r["id"],
            "name": r["name"], "condition": json.dumps({r["condition_type"]: r["condition_value"]}),
            "action": r["action"], "severity": r["severity"],
            "explanation": r.get("explanation", f"Rule {r['id']} triggered"),
            "remediation": r.get("remediation", DEFAULT_REMEDIATION), "enabled": bool(r.get("enabled", True)),
            "active": bool(raw.get("active", True)), "tenant_id": raw.get("tenant_id"),
        })
    return out


def _schema_two(raw: dict) -> list[dict]:
    return [{
        "policy_id": raw["policy_id"], "policy_name": raw["name"], "framework": (raw.get("frameworks") or ["custom"])[0],
        "version": str(raw.get("version", "1.0.0")), "schema_version": 2, "rule_ord": i, "rule_id": r["rule_id"],
        "name": r["name"], "condition": json.dumps(r["condition"]), "action": r["action"],
        "severity": r.get("severity", "medium"), "explanation": r.get("message", ""),
        "remediation": r.get("remediation", DEFAULT_REMEDIATION), "enabled": bool(r.get("enabled", True)),
        "active": bool(raw.get("active", True)), "tenant_id": raw.get("tenant_id"),
    } for i, r in enumerate(raw["rules"])]


def _texts(row: dict) -> dict:
    """YAML reads bare words such as ``off`` or ``1.0`` as other types; text columns stay text."""
    other = {"schema_version", "rule_ord", "enabled", "active"}
    return {k: v if v is None or k in other else str(v) for k, v in row.items()}


def parse_policy(text: str, engine_only: bool = False) -> list[dict]:
    """Rule rows of one file; a file with any defect is rejected as a whole."""
    import yaml  # only where policy files are read

    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ValueError("not a mapping")
    if "policy_id" in raw and not engine_only:
        return _schema_two(raw)
    return _schema_one(raw)


def read_policies(spark: SparkSession, path: str, engine_only: bool = False) -> DataFrame:
    """One row per rule, or one row with ``error`` set per rejected file.

    The last file (by path) wins where two define the same policy.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yaml").text(path, wholetext=True)
    sources = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))

    def parse(batches):
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["text"]):
                try:
                    rows += [{"file": file, "error": None, **_texts(r)} for r in parse_policy(text, engine_only)]
                except Exception as exc:  # a bad file is reported, not fatal
                    rows.append({"file": file, "error": str(exc) or type(exc).__name__})
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _COLUMNS})

    parsed = sources.mapInPandas(parse, ROW)
    winner = parsed.where("error IS NULL").groupBy("policy_id").agg(F.max("file").alias("file"))
    good = parsed.where("error IS NULL").join(winner, ["policy_id", "file"], "left_semi")
    return good.unionByName(parsed.where("error IS NOT NULL"))


def policy_errors(rules: DataFrame) -> DataFrame:
    return rules.where("error IS NOT NULL").select("file", "error")


def to_rules(rules: DataFrame) -> list[Rule]:
    """Parsed rows as rule objects.  Rules are configuration, a few rows per policy file."""
    out = []
    for r in rules.where("error IS NULL").orderBy("policy_id", "rule_ord").collect():
        condition = json.loads(r["condition"])
        out.append(Rule(
            r["policy_id"], r["policy_name"], r["framework"], r["version"], r["schema_version"], r["rule_ord"],
            r["rule_id"], r["name"], r["action"], r["severity"], r["explanation"], r["remediation"],
            **condition_parts(condition), enabled=r["enabled"], active=r["active"], tenant_id=r["tenant_id"],
            condition=condition_label(condition)))
    return out
