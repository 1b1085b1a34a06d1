"""Redaction modes, the token vault and restoring from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import detect as D
from ..functions.masking import content_hash
from ..functions.spans import let
from ..functions.splice import merged, record_types, redaction

MODES = ("mask", "hash", "tokenize")
#: A numbered token as redaction writes it.
STORED_TOKEN = r"\[[A-Z][A-Z_]*_[0-9]{3,}\]"


def _redacted(df: DataFrame, text: str, mode: str, overlaps: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if overlaps not in ("splice", "merge"):
        raise ValueError("overlaps must be 'splice' or 'merge'")
    t = F.col(text)
    found = D.with_evidence(df, text).select(
        *df.columns, "evidence", D.hits(text).alias("_hits")
    )
    hits = F.col("_hits") if overlaps == "splice" else merged(F.col("_hits"), t)
    return found.select(*df.columns, "evidence", hits.alias("_hits")).select(
        *df.columns, "evidence",
        D.once(redaction(t, F.col("_hits"), "hash" if mode == "hash" else "mask")).alias("_red"),
    )


def redact(df: DataFrame, text: str = "text", mode: str = "mask", overlaps: str = "merge") -> DataFrame:
    """Append ``redacted_text``, ``redaction_count``, ``categories_redacted``, ``entity_types``.

    ``overlaps="splice"`` reproduces naive splicing by original offsets;
    ``overlaps="merge"`` first unions overlapping hits so no raw value survives.
    Map-side only: no shuffle, the raw values never leave the row.
    """
    red = F.col("_red")
    return _redacted(df, text, mode, overlaps).select(
        *df.columns,
        red["text"].alias("redacted_text"),
        F.size(red["records"]).alias("redaction_count"),
        F.array_sort(F.array_distinct(F.transform(
            red["records"], lambda r: D.det_category(r["det"])))).alias("categories_redacted"),
        record_types(red["records"]).alias("entity_types"),
    )


def redaction_records(
    df: DataFrame, *keys: str, text: str = "text", mode: str = "mask", overlaps: str = "merge"
) -> DataFrame:
    """One audit row per replacement: token, type, offsets and the hash of the value."""
    rows = _redacted(df, text, mode, overlaps).select(*keys, F.inline_outer("_red.records"))
    return rows.where(F.col("token").isNotNull()).select(
        *keys, "token", D.det_type(F.col("det")).alias("entity_type"),
        D.det_category(F.col("det")).alias("category"),
        F.col("start").alias("original_start"), F.col("end").alias("original_end"),
        content_hash(F.col("value")).alias("original_hash"),
        F.lit(mode == "tokenize").alias("reversible"),
    )


def tokenize(
    df: DataFrame, key: Column, as_of: Column, *, text: str = "text",
    tenant: str = "tenant_id", session: str = "session_id", doc: str = "doc_id",
    ttl_hours: int = C.VAULT_TTL_HOURS, overlaps: str = "merge",
) -> DataFrame:
    """Vault rows of a tokenising redaction: encrypted values with an expiry.

    The document id is part of the vault key, so equal tokens of two documents in
    one session do not overwrite each other.  The redacted text itself comes from
    :func:`redact`, whose tokens are the same.
    """
    return _vault_rows(_redacted(df, text, "tokenize", overlaps).select(tenant, session, doc, "_red"),
                       key, as_of, tenant, session, doc, ttl_hours)


def _vault_rows(redacted: DataFrame, key: Column, as_of: Column, tenant: str, session: str, doc: str,
                ttl_hours: int) -> DataFrame:
    rows = redacted.select(tenant, session, doc, F.inline_outer("_red.records"))
    return rows.where(F.col("token").isNotNull()).select(
        tenant, session, doc, "token",
        D.det_type(F.col("det")).alias("entity_type"),
        F.aes_encrypt(F.encode("value", "UTF-8"), key, F.lit("GCM")).alias("encrypted_value"),
        as_of.alias("created_at"),
        (as_of + F.make_dt_interval(hours=F.lit(ttl_hours))).alias("expires_at"),
    )


def redact_to_vault(
    df: DataFrame, key: Column, as_of: Column, *, text: str = "text",
    tenant: str = "tenant_id", session: str = "session_id", doc: str = "doc_id",
    ttl_hours: int = C.VAULT_TTL_HOURS, overlaps: str = "merge",
) -> tuple[DataFrame, DataFrame]:
    """Tokenised texts (keys and ``redacted_text``) and their vault rows, from one pass over the texts.

    Texts are dealt by document once, after redaction.  Where both results end up in one job, Spark reuses that
    exchange; grouping and joining by document need no other.
    """
    dealt = _redacted(df, text, "tokenize", overlaps).select(tenant, session, doc, "_red") \
        .repartition(tenant, session, doc).select(tenant, session, doc, D.once(F.col("_red")).alias("_red"))
    return (dealt.select(tenant, session, doc, F.col("_red.text").alias("redacted_text")),
            _vault_rows(dealt, key, as_of, tenant, session, doc, ttl_hours))


def restore(
    redacted: DataFrame, vault: DataFrame, key: Column, as_of: Column, *, text: str = "redacted_text",
    tenant: str = "tenant_id", session: str = "session_id", doc: str = "doc_id",
) -> DataFrame:
    """Put vaulted values back where they are still valid.

    The vault is reduced to one small map per document before it meets the text,
    which is cut at its tokens once.  Tokens without a valid entry stay; of two
    entries for one token the greater value counts.  Restored values are not
    searched for tokens again.
    """
    valid = vault.where(F.col("expires_at") > as_of).select(
        tenant, session, doc,
        F.struct("token", F.decode(F.aes_decrypt("encrypted_value", key, F.lit("GCM")), "UTF-8").alias("value"))
        .alias("pair"),
    )
    per_doc = valid.groupBy(tenant, session, doc).agg(F.array_sort(F.collect_list("pair")).alias("_pairs"))
    joined = redacted.join(per_doc, [tenant, session, doc], "left")
    last_of_token = F.filter("_pairs", lambda p, i: ~F.get(F.col("_pairs"), i + 1)["token"].eqNullSafe(p["token"]))
    return joined.select(
        *redacted.columns,
        F.when(F.col("_pairs").isNull(), F.col(text)).otherwise(_put_back(F.col(text), last_of_token))
        .alias("restored_text")
    )


def restore_then(
    requests: DataFrame, vault: DataFrame, key: Column, at: str = "asked_at", *, text: str = "redacted_text",
    tenant: str = "tenant_id", session: str = "session_id", doc: str = "doc_id",
) -> DataFrame:
    """Put back the values that were valid when each request was made: created by then and not yet expired.

    An interval join with equal keys: requests and vault meet by document, and intervals are tested in the document's
    small list of entries.  Of several valid entries for one token the last created counts.  A request without a time
    restores nothing.
    """
    value = F.decode(F.aes_decrypt("encrypted_value", key, F.lit("GCM")), "UTF-8").alias("value")
    entries = vault.select(tenant, session, doc, F.struct("token", "created_at", value, "expires_at").alias("entry"))
    per_doc = entries.groupBy(tenant, session, doc).agg(F.array_sort(F.collect_list("entry")).alias("_entries"))
    joined = requests.join(per_doc, [tenant, session, doc], "left")
    valid = F.filter("_entries", lambda e: (e["created_at"] <= F.col(at)) & (e["expires_at"] > F.col(at)))
    staged = joined.select(*requests.columns, D.once(valid).alias("_valid"))
    last_of_token = F.filter("_valid", lambda e, i: ~F.get(F.col("_valid"), i + 1)["token"].eqNullSafe(e["token"]))
    return staged.select(
        *requests.columns,
        F.when(F.coalesce(F.size("_valid") > 0, F.lit(False)), _put_back(F.col(text), last_of_token))
        .otherwise(F.col(text)).alias("restored_text"))


def _put_back(text: Column, pairs: Column) -> Column:
    """The text with its tokens looked up in sorted pairs; halving finds a token, a map would be read through."""
    def found(sorted_pairs: Column, token: Column) -> Column:
        ends = F.struct(F.lit(0).alias("low"), F.size(sorted_pairs).alias("high"))

        def halved(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            below = F.get(sorted_pairs, middle)["token"] < token
            return F.struct(F.when(below, middle + 1).otherwise(acc["low"]).alias("low"),
                            F.when(below, acc["high"]).otherwise(middle).alias("high"))

        halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_pairs) + F.lit(1))).cast("int"))
        at = F.aggregate(halvings, ends, lambda acc, i: F.when(acc["low"] < acc["high"], halved(acc, i)).otherwise(acc),
                         lambda acc: acc["low"])
        return let(F.get(sorted_pairs, at), lambda p: F.when(p["token"] == token, p["value"]).otherwise(token))

    pattern = F.lit(STORED_TOKEN)
    return let(pairs, lambda known: let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda tokens: F.array_join(F.transform(
            F.split(text, STORED_TOKEN, -1),
            lambda between, i: F.concat(between, F.when(
                i < F.size(tokens), found(known, F.get(tokens, i))).otherwise(""))), "")))


def invalidate_sessions(vault: DataFrame, sessions: DataFrame) -> DataFrame:
    """The vault without the rows of the given (tenant, session) pairs."""
    return vault.join(sessions.select("tenant_id", "session_id"), ["tenant_id", "session_id"], "left_anti")


def redact_for_industry(df: DataFrame, text: str = "text", industry: str = "") -> DataFrame:
    """Inspect and mask; returns the text and the types replaced.  The industry does not change the rules."""
    return redact(df, text, "mask", "splice").drop("redaction_count", "categories_redacted")


def highlighted_tokens(text: Column) -> Column:
    """Replacement tokens in a redacted text, without their brackets."""
    return F.regexp_extract_all(text, F.lit(C.TOKEN_PATTERN), F.lit(1))


def preview(df: DataFrame, text: str = "text", chars: int = 2000) -> DataFrame:
    """Append the redacted preview of the first ``chars`` characters.

    Entities are found in the whole text; those starting beyond the preview are
    left out and one that straddles its end is cut.
    """
    t = F.col(text)
    head = F.left(t, F.lit(chars))
    found = D.with_evidence(df, text).select(
        *df.columns, "evidence", D.hits(text).alias("_hits")
    )
    visible = F.filter("_hits", lambda h: h["start"] < chars)
    staged = found.select(*df.columns, "evidence", visible.alias("_hits"), (F.size("_hits") > 0).alias("_any"),
                          head.alias("_head"))
    return staged.select(
        *df.columns, "evidence",
        F.when(F.col("_any"), redaction(F.col("_head"), F.col("_hits"))["text"]).alias("redacted_preview"),
    )
