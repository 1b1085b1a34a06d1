"""Threat detectors that are a handful of patterns each: first match, all matches, spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.detect import digit_level, folded, once
from ..functions.spans import DOTALL, MULTILINE, PLAIN, guarded_rlike, let, literal, matches, spans_text


def first_match(text: Column, table, flags: str) -> Column:
    """Name of the first pattern that occurs, or null; later patterns are not tried."""
    return F.coalesce(*[F.when(text.rlike(flags + regex), F.lit(name)) for name, regex in table])


def any_match(text: Column, patterns, flags: str) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(flags + p) for p in patterns])


def named_matches(text: Column, table, flags: str) -> Column:
    """All matches of all patterns in table order: ``array<struct<name,value>>``."""

    def of_pattern(name: str, regex: str) -> Column:
        found = F.transform(matches(text, flags + regex), lambda m: F.struct(
            F.lit(name).alias("name"), m.alias("value")))
        none = F.array().cast("array<struct<name:string,value:string>>")
        return F.when(text.rlike(flags + regex), found).otherwise(none)

    return F.flatten(F.array(*[of_pattern(name, regex) for name, regex in table]))


def hard_block(text: Column) -> Column:
    return first_match(text, C.HARD_BLOCKS, DOTALL)


def hijack(text: Column) -> Column:
    return first_match(text, C.HIJACK_INDICATORS, DOTALL)


def unsafe_urls(text: Column) -> Column:
    return named_matches(text, C.UNSAFE_URLS, PLAIN)


def fenced_code(text: Column) -> Column:
    """Contents of fenced code blocks, newline-joined ('' when there are none)."""
    fence = "(?sU)" + C.CODE_FENCE
    blocks = F.regexp_extract_all(text, F.lit(fence), F.lit(1))
    return F.when(text.contains("```"), F.array_join(blocks, "\n")).otherwise("")


def dangerous_code(text: Column) -> Column:
    return let(fenced_code(text), lambda code: named_matches(code, C.DANGEROUS_CODE, MULTILINE))


def memory_poison(text: Column) -> Column:
    return any_match(text, C.MEMORY_POISON, DOTALL)


def argument_threats(arguments: Column) -> Column:
    """``array<struct<name,risk>>`` over the text of a tool call's arguments."""
    return F.array_compact(F.array(*[
        F.when(arguments.rlike(MULTILINE + regex), F.struct(
            F.lit(name).alias("name"), F.lit(risk).alias("risk")))
        for name, risk, regex in C.ARGUMENT_THREATS
    ]))


def poisoning_threats(text: str, folded: str = "_hay") -> Column:
    """``array<struct<threat_type,severity,count,payload_snippet,positions>>``.

    Each pattern runs only where its leading literal occurs; the two with a lazy
    gap also need the literal they end with, so a long text without it is not
    scanned from every possible start.
    """
    guards = {
        "HTML Comment Injection": f"contains(`{text}`, '-->') AND ",
        "Exfiltration URL": f"contains(`{text}`, '=') AND ",
        "Conditional Trigger": "(" + " OR ".join(
            f"contains(`{folded}`, '{x}')" for x in ("say", "tell", "respond")) + ") AND ",
        "Zero-Width Characters": f"octet_length(`{text}`) > length(`{text}`) AND ",
    }

    def of_pattern(name: str, severity: str, regex: str) -> Column:
        pattern = DOTALL + regex
        test = guards.get(name, "") + guarded_rlike(f"`{text}`", regex, DOTALL, folded)
        found = F.expr(spans_text(f"`{text}`", pattern, when=test))
        return let(found, lambda s: F.when(F.size(s) > 0, F.struct(
            F.lit(name).alias("threat_type"),
            F.lit(severity).alias("severity"),
            F.size(s).alias("count"),
            F.left(F.get(s, F.lit(0))["value"], F.lit(100)).alias("payload_snippet"),
            F.transform(F.slice(s, 1, 3), lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"))).alias("positions"),
        )))

    return F.array_compact(F.array(*[of_pattern(*p) for p in C.POISONING_PATTERNS]))


def poisoning_scan(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Poisoning verdict per document, with the ingestion action."""
    threats = F.col("threats")
    risk = F.coalesce(
        F.array_max(F.transform(threats, lambda t: reduce(
            lambda acc, kv: acc.when(t["severity"] == kv[0], F.lit(kv[1])),
            list(C.POISONING_RISK.items())[1:],
            F.when(t["severity"] == "critical", F.lit(C.POISONING_RISK["critical"])),
        ))),
        F.lit(0.0),
    )
    names = F.array_join(F.transform(F.slice(threats, 1, 3), lambda t: t["threat_type"]), ", ")
    prepared = df.select(*keys, text, folded(F.col(text)).alias("_hay"))
    scanned = prepared.select(*keys, once(poisoning_threats(text)).alias("threats"))
    return scanned.select(
        *keys,
        "threats",
        (F.size(threats) > 0).alias("is_poisoned"),
        risk.alias("risk_score"),
        F.when(F.size(threats) > 0, F.concat(
            F.lit("Document contains "), F.size(threats).cast("string"), F.lit(" threat(s): "), names,
        )).otherwise("Document passed poisoning scan").alias("explanation"),
        F.when(F.size(threats) > 0, "quarantine").otherwise("allow").alias("action"),
    )


def toxicity(text: Column) -> Column:
    return any_match(text, C.TOXICITY_PATTERNS, PLAIN)


def query_injection(query: Column) -> Column:
    return first_match(query, C.QUERY_INJECTIONS, PLAIN)


def query_risk(query: Column) -> Column:
    """Highest score of the fishing patterns found in a retrieval query."""
    return F.greatest(F.lit(0.0), *[
        F.when(query.rlike(PLAIN + regex), F.lit(score)).otherwise(0.0) for score, regex in C.QUERY_RISKS
    ])


# ------------------------------------------------------------------ profiles
def file_profile(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The file-scanner profile: its own eight patterns, five injections and redaction."""
    t = F.col(text)
    prepared = df.select(*keys, text, folded(t).alias("_hay"), digit_level(t).alias("_digits"))
    # What a match needs besides its leading literals: a digit level or a character.
    needs = {
        "SSN": "_digits >= 2", "Credit Card": "_digits >= 4", "Phone": "_digits >= 2", "IP Address": "_digits >= 1",
        "MRN": "_digits >= 2", "Bank Account": "_digits >= 2", "Email": "contains(_hay, '@')",
    }

    def when(label: str, regex: str) -> str:
        test = guarded_rlike(f"`{text}`", regex, PLAIN, "_hay")
        return f"{needs[label]} AND {test}" if label in needs else test

    found = F.expr("flatten(array(" + ", ".join(
        spans_text(f"`{text}`", PLAIN + regex, {"label": label, "type": kind, "severity": severity}, when(label, regex))
        for label, kind, severity, regex in C.FILE_PROFILE
    ) + "))")
    injections = F.expr("array_compact(array(" + ", ".join(
        f"CASE WHEN {guarded_rlike(f'`{text}`', regex, PLAIN, '_hay')} THEN {literal(name)} END"
        for name, regex in C.FILE_PROFILE_INJECTIONS
    ) + "))")
    staged = prepared.select(
        *keys, t.alias("_text"), once(found).alias("entities"), once(injections).alias("injections"))
    entities = F.col("entities")
    severity_risk = F.create_map(*[F.lit(x) for kv in C.PROFILE_RISK.items() for x in kv])
    risk = F.greatest(
        F.lit(0.0),
        F.array_max(F.transform(entities, lambda e: severity_risk[e["severity"]])),
        F.when(F.size("injections") > 0, F.lit(C.FILE_INJECTION_RISK)),
    )
    redacted = F.aggregate(entities, F.col("_text"), lambda acc, e: F.replace(
        acc, e["value"],
        F.concat(F.lit("["), F.upper(F.replace(e["label"], F.lit(" "), F.lit("_"))), F.lit("]")),
    ))
    scored = staged.select(*keys, "entities", "injections", risk.alias("risk_score"), redacted.alias("redacted"))
    r = F.col("risk_score")
    return scored.select(
        *keys, "entities", "injections", "risk_score", "redacted",
        F.when(r > 0.7, "Block and review").when(r > 0.3, "Review recommended")
        .otherwise("Safe to proceed").alias("recommendation"),
        file_severity(r).alias("severity_label"),
    )


def file_severity(risk: Column) -> Column:
    return (
        F.when(risk > 0.7, "CRITICAL").when(risk > 0.5, "HIGH").when(risk > 0.3, "MEDIUM").otherwise("CLEAN")
    )


def quick_scan(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The gateway's quick profile: presence only, with regex replacement."""
    t = F.col(text)
    labels = F.array_compact(F.array(*[
        F.when(t.rlike(PLAIN + regex), F.lit(label)) for label, _, regex in C.QUICK_PROFILE
    ]))
    injections = reduce(lambda a, b: a + b, [
        F.when(t.rlike(PLAIN + p), 1).otherwise(0) for p in C.QUICK_INJECTIONS
    ])
    staged = df.select(*keys, t.alias("_text"), labels.alias("labels"), injections.alias("injections"))
    has = lambda label: F.array_contains(F.col("labels"), label)
    risk = F.greatest(
        F.when(F.col("injections") > 0, F.lit(C.QUICK_INJECTION_RISK)).otherwise(0.0),
        *[F.when(has(label), F.lit(C.PROFILE_RISK[severity])).otherwise(0.0)
          for label, severity, _ in C.QUICK_PROFILE],
    )
    redacted = F.col("_text")
    for label, _, regex in C.QUICK_PROFILE:
        token = "[" + label.upper().replace(" ", "_") + "]"
        redacted = F.regexp_replace(redacted, F.lit(PLAIN + regex), F.lit(token))
    return staged.select(
        *keys, "labels", "injections", risk.alias("risk_score"),
        ((risk > 0.7) | (F.col("injections") > 0)).alias("blocked"),
        redacted.alias("redacted"),
    )
