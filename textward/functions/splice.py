"""Redaction of a row's own hits: a fold from the last to the first that keeps only the near end of its result at hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as C
from .detect import HIT_TYPE, det_confidence, det_label, det_type
from .masking import content_hash
from .spans import array_text, let, scan

LABELS = sorted({C.ENTITY_TYPES[t][1] for t, _, _ in C.ENTITY_PATTERNS})
RECORD_TYPE = "array<struct<token:string,det:int,start:int,end:int,value:string>>"
#: Characters of a chunk; cutting a piece out of a text costs the chunks at its ends, not all that stands before it.
CHUNK = 512
#: Characters of the redacted tail that a fold keeps at hand; what is behind them is not copied again.
NEAR = 4096


def merged(hits: Column, text: Column) -> Column:
    """Union overlapping hits into one covering hit, named after its best member.

    Rank inside a union: confidence, then length, then detection order.  Without
    this step overlapping hits are spliced one over the other and leave parts of
    the raw value behind.
    """
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), h["end"].alias("end"),
        F.struct(
            det_confidence(h["det"]).alias("confidence"), (h["end"] - h["start"]).alias("length"),
            (-h["det"]).alias("order"),
        ).alias("rank"),
    )))
    span = "struct<start:int,end:int,rank:struct<confidence:double,length:int,order:int>>"

    def grown(current: Column, h: Column) -> Column:
        return F.when(current.isNull() | (h["start"] >= current["end"]), h).otherwise(F.struct(
            current["start"].alias("start"), F.greatest(current["end"], h["end"]).alias("end"),
            F.greatest(current["rank"], h["rank"]).alias("rank"),
        ))

    def closed(current: Column, h: Column) -> Column:
        return F.when(h["start"] >= current["end"], current)

    unions = let(
        scan(ordered, F.lit(None).cast(span), span, grown, closed),
        lambda done: F.array_compact(F.concat(done["out"], F.array(done["state"]))),
    )
    return let(chunks(text), lambda parts: F.transform(unions, lambda u: F.struct(
        (-u["rank"]["order"]).alias("det"), u["start"].alias("start"), u["end"].alias("end"),
        piece(parts, u["start"], u["end"]).alias("value"),
    ))).cast(HIT_TYPE)


def chunks(text: Column) -> Column:
    """The text in runs of CHUNK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(parts: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` to before ``end`` of the text that was cut into ``parts``."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head, tail = F.coalesce(F.get(parts, first), F.lit("")), F.coalesce(F.get(parts, last), F.lit(""))
    across = F.concat(
        F.substr(head, start % CHUNK + 1),
        F.when(last > first + 1, F.array_join(F.slice(parts, first + 2, last - first - 1), "")).otherwise(""),
        F.left(tail, end % CHUNK),
    )
    return F.when(start >= end, "").when(first == last, F.substr(head, start % CHUNK + 1, end - start)).otherwise(across)


def _token(label: Column, counter: Column) -> Column:
    text = counter.cast("string")
    return F.concat(F.lit("["), label, F.lit("_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text),
                    F.lit("]"))


def _hash_token(label: Column, value: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit(":HASH:"), content_hash(value, 12), F.lit("]"))


def _next_token(counts: Column, h: Column, mode: str) -> Column:
    label = det_label(h["det"])
    return _hash_token(label, h["value"]) if mode == "hash" else _token(label, F.get(counts, _slot(h)) + 1)


def _slot(h: Column) -> Column:
    return F.array_position(F.expr(array_text(LABELS)), det_label(h["det"])).cast("int") - 1


def _counted(counts: Column, h: Column) -> Column:
    return let(_slot(h), lambda slot: F.transform(counts, lambda c, i: F.when(i == slot, c + 1).otherwise(c)))


def _record(h: Column, token: Column) -> Column:
    return F.struct(token.alias("token"), h["det"].alias("det"), (-h["back"]).alias("start"), h["end"].alias("end"),
                    h["value"].alias("value"))


def _spliced(text: Column, ordered: Column, mode: str) -> Column:
    """Every hit is spliced over what those behind it have left.

    Only the first characters of the tail are at hand (``near``); longer ones are closed off in runs (``far``, from the
    last to the first).  A hit that reaches beyond what is at hand takes the runs back, so the text is copied once per
    such hit and not once per hit.
    """
    start = F.struct(
        F.length(text).alias("pos"), F.lit("").alias("near"), F.array().cast("array<string>").alias("far"),
        F.array_repeat(F.lit(0), len(LABELS)).alias("counts"),
    )

    def step(parts: Column):
        def shifted(acc: Column, h: Column, near: Column, far: Column) -> Column:
            long = F.length(near) > 2 * NEAR
            return F.struct(
                (-h["back"]).alias("pos"), F.when(long, F.left(near, F.lit(NEAR))).otherwise(near).alias("near"),
                F.when(long, F.concat(far, F.array(F.substr(near, F.lit(NEAR + 1))))).otherwise(far).alias("far"),
                _counted(acc["counts"], h).alias("counts"))

        def one(acc: Column, h: Column) -> Column:
            over = h["end"] - acc["pos"]
            beyond = over > F.length(acc["near"])
            whole = F.concat(acc["near"], F.array_join(F.reverse(acc["far"]), ""))
            near = F.concat(_next_token(acc["counts"], h, mode), F.when(
                over <= 0, F.concat(piece(parts, h["end"], acc["pos"]), acc["near"]))
                .otherwise(F.substr(F.when(beyond, whole).otherwise(acc["near"]), over + 1)))
            far = F.when(beyond, F.array().cast("array<string>")).otherwise(acc["far"])
            return let(near, lambda n: shifted(acc, h, n, far))

        return one

    def finished(parts: Column) -> Column:
        done = scan(ordered, start, RECORD_TYPE.removeprefix("array<")[:-1], step(parts),
                    lambda acc, h: _record(h, _next_token(acc["counts"], h, mode)))
        return let(done, lambda d: F.struct(
            F.concat(F.left(text, d["state"]["pos"]), d["state"]["near"],
                     F.array_join(F.reverse(d["state"]["far"]), "")).alias("text"),
            d["out"].alias("records")))

    return let(chunks(text), finished)


def redaction(text: Column, hits: Column, mode: str = "mask") -> Column:
    """``struct<text, records>`` after replacing every hit by its token.

    Hits are taken by start descending, ties in detection order, so a counter
    ``_001`` names the last occurrence.  Offsets are those of the original text;
    overlapping hits therefore cut into each other's tokens, as specified.  Time is
    in proportion to the text and its hits, but for hits that reach over thousands of
    characters of others' tokens: each of those copies what is behind it.
    """
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(
        (-h["start"]).alias("back"), h["det"].alias("det"), h["end"].alias("end"),
        h["value"].alias("value"),
    )))
    untouched = F.struct(text.alias("text"), F.array().cast(RECORD_TYPE).alias("records"))
    return F.when(F.size(hits) > 0, let(ordered, lambda hs: _spliced(text, hs, mode))).otherwise(untouched)


def record_types(records: Column) -> Column:
    return F.transform(records, lambda r: det_type(r["det"]))
