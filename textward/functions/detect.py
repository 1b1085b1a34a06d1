"""Which patterns occur in a text: one 64-bit evidence mask per row.

Every detector owns one bit.  A row's mask is computed once, in generated code,
and every flag, score and decision after that is integer arithmetic on it, so a
query that only needs decisions never builds match arrays.

Most patterns contain a literal (or a digit run) that any match must contain.
Those literals are tested first with a byte search on a case-folded copy of the
text, and the regular expression runs only where the test passes.  The folded
copy maps the four non-ASCII characters that case-insensitively equal an ASCII
letter (long s, dotless and dotted i, Kelvin sign), so the test never loses a
match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog as C
from .spans import MULTILINE, PLAIN, array_text, literal, rlike_text, spans_text

N_ENTITY = len(C.ENTITY_PATTERNS)
N_INJECTION = len(C.INJECTION_PATTERNS)
INJECTION_BIT = N_ENTITY
TOXICITY_BIT = N_ENTITY + N_INJECTION

# Literals each pattern cannot match without: all groups must hold, a group
# holds when any of its literals occurs.  ``digits`` is the digit level below.
_ENTITY_NEEDS: tuple[tuple[int, tuple[tuple[str, ...], ...]], ...] = (
    (0, (("@",),)),
    (2, ()), (1, ()),
    (1, ((".",),)), (0, ((":",),)),
    (2, (("-",),)), (3, ()),
    (2, (("mrn",),)), (2, (("medical record",),)),
    (4, ()), (4, ()), (4, ()), (4, ()), (4, ()),
    (2, (("cvv",),)), (2, (("cvc",),)), (2, (("security code",),)),
    (2, (("account",),)), (3, (("routing", "aba"),)),
    (0, (("sk-",),)), (0, (("-", "_"),)), (0, (("api",), ("key",))), (0, (("bearer",),)),
    (0, (("akia",),)), (0, (("aws",), ("secret",), ("access",))),
    (0, (("eyj",),)),
    (0, (("-----begin",),)), (0, (("-----begin",), ("openssh",))),
    (0, (("password",),)), (0, (("passwd",),)), (0, (("pwd",),)),
)
_INJECTION_NEEDS: tuple[tuple[tuple[str, ...], ...], ...] = (
    (("ignore", "disregard", "forget", "override"),
     ("instruction", "prompt", "rule", "guideline", "constraint")),
    (("dan", "anything", "jail", "unrestricted", "developer", "god"),),
    (("you",), ("now", "pretend", "act", "new")),
    (("your",), ("repeat", "print", "what", "reveal")),
    (("when", "hidden", "contains", "following"),),
    (),
    (("<", "["),),
    (("execute", "run", "eval", "__import__"),),
    (("send", "exfil", "upload"),),
)
_TOXICITY_NEEDS: tuple[tuple[tuple[str, ...], ...], ...] = (
    (("how",), ("bomb", "explosive", "poison", "malware", "virus", "ransomware")),
    (("step",), ("hack", "attack", "exploit", "murder", "kill")),
    (("generate",), ("sexual", "porn", "nude", "explicit")),
)

assert len(_ENTITY_NEEDS) == N_ENTITY and len(_INJECTION_NEEDS) == N_INJECTION


# ------------------------------------------------------------------ masks
def mask_of(bits) -> int:
    return reduce(lambda a, b: a | (1 << b), bits, 0)


def entity_confidence(entity_type: str) -> float:
    return C.HIGH_CONFIDENCE if entity_type in C.HIGH_CONFIDENCE_TYPES else C.BASE_CONFIDENCE


def entity_bits(predicate) -> int:
    """Mask of entity patterns whose type satisfies ``predicate``."""
    return mask_of(i for i, (t, _, _) in enumerate(C.ENTITY_PATTERNS) if predicate(t))


def injection_bits(predicate) -> int:
    return mask_of(
        INJECTION_BIT + i for i, p in enumerate(C.INJECTION_PATTERNS) if predicate(p)
    )


def category_mask(category: str) -> int:
    return entity_bits(lambda t: C.ENTITY_TYPES[t][0] == category)


ENTITY_MASK = mask_of(range(N_ENTITY))
INJECTION_MASK = injection_bits(lambda p: True)
TOXICITY_MASK = mask_of(TOXICITY_BIT + i for i in range(len(C.TOXICITY_PATTERNS)))


def bit_test(mask: int, evidence: str = "evidence") -> str:
    return f"({evidence} & {mask}L) != 0"


def any_bit(mask: int, evidence: str = "evidence") -> Column:
    return F.expr(bit_test(mask, evidence))


# ------------------------------------------------------------------ prefilter
def folded(text: Column) -> Column:
    """Lower-cased text in which every case variant of an ASCII letter is that letter."""
    for variant, letter in (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"), ("\u212a", "k")):
        text = F.replace(text, F.lit(variant), F.lit(letter))
    return F.lower(text)


def digit_level(text: Column) -> Column:
    """0 no digit, 1 some, 2 three in a row, 3 nine in a row, 4 thirteen in a row."""
    return (
        F.when(~text.rlike(r"(?U)\d"), 0)
        .when(~text.rlike(r"(?U)\d{3}"), 1)
        .when(~text.rlike(r"(?U)\d{9}"), 2)
        .when(~text.rlike(r"(?U)\d{13}"), 3)
        .otherwise(4)
    )


def _holds(groups) -> list[str]:
    return [
        "(" + " OR ".join(f"contains(_hay, {literal(x)})" for x in group) + ")" for group in groups
    ]


def _any_of(terms: list[str]) -> str:
    """Balanced bitwise OR, so the expression does not nest one level per pattern."""
    while len(terms) > 1:
        pairs = [terms[i:i + 2] for i in range(0, len(terms), 2)]
        terms = [f"({p[0]} | {p[1]})" if len(p) == 2 else p[0] for p in pairs]
    return terms[0]


def _bit(position: int, tests: list[str]) -> str:
    return f"CASE WHEN {' AND '.join(tests)} THEN {1 << position}L ELSE 0L END"


def evidence_text(text: str) -> str:
    """SQL text of the mask over a text column and its prefilter columns."""
    terms = []
    for i, ((_, _, regex), (level, groups)) in enumerate(zip(C.ENTITY_PATTERNS, _ENTITY_NEEDS)):
        guards = ([f"_digits >= {level}"] if level else []) + _holds(groups)
        terms.append(_bit(i, [*guards, rlike_text(text, MULTILINE + regex)]))
    for i, (pattern, groups) in enumerate(zip(C.INJECTION_PATTERNS, _INJECTION_NEEDS)):
        # Only the hidden-character class has no literal: it needs non-ASCII bytes.
        guards = _holds(groups) or [f"octet_length({text}) > _length"]
        terms.append(_bit(INJECTION_BIT + i, [*guards, rlike_text(text, MULTILINE + pattern[4])]))
    for i, (regex, groups) in enumerate(zip(C.TOXICITY_PATTERNS, _TOXICITY_NEEDS)):
        terms.append(_bit(TOXICITY_BIT + i, [*_holds(groups), rlike_text(text, PLAIN + regex)]))
    return _any_of(terms)


def once(value: Column) -> Column:
    """Keep an expensive column from being substituted into filters and projections above it.

    Catalyst pushes a filter on a derived column below the projection by copying
    the column's expression into it, once per reference.  A condition on the
    partition id is always true but not deterministic, so the projection stays a
    barrier and the value is computed once per row.  Filters on plain columns
    belong before the detectors for the same reason.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def with_evidence(df: DataFrame, text: str = "text", out: str = "evidence") -> DataFrame:
    """Append the evidence mask of ``text``.

    The prefilter columns are materialised in their own projection: each is used
    many times, so Catalyst keeps the projections apart and evaluates them once.
    """
    t = F.col(text)
    keep = [c for c in df.columns if c != out]
    prepared = df.select(
        *keep,
        folded(t).alias("_hay"),
        digit_level(t).alias("_digits"),
        F.length(t).alias("_length"),
    )
    return prepared.select(*keep, once(F.expr(evidence_text(f"`{text}`"))).alias(out))


# ------------------------------------------------------------------ hits
HIT_TYPE = "array<struct<det:int,start:int,end:int,value:string>>"


def hits(text: str = "text", evidence: str = "evidence") -> Column:
    """All entity matches in detection order: ``array<struct<det,start,end,value>>``.

    Only patterns whose bit is set are extracted.  ``value`` is the raw match and
    is meant for masking, hashing or the vault, never for output.
    """
    per_pattern = ", ".join(
        spans_text(f"`{text}`", MULTILINE + regex, {"det": i}, bit_test(1 << i, evidence))
        for i, (_, _, regex) in enumerate(C.ENTITY_PATTERNS)
    )
    return once(F.expr(
        f"CASE WHEN {bit_test(ENTITY_MASK, evidence)} THEN flatten(array({per_pattern})) "
        f"ELSE CAST(array() AS {HIT_TYPE}) END"
    ))


def injection_counts(text: str = "text", evidence: str = "evidence") -> Column:
    """Number of matches per injection pattern (0 where the bit is clear)."""
    counts = ", ".join(
        f"CASE WHEN {bit_test(1 << (INJECTION_BIT + i), evidence)} "
        f"THEN regexp_count(`{text}`, {literal(MULTILINE + p[4])}) ELSE 0 END"
        for i, p in enumerate(C.INJECTION_PATTERNS)
    )
    return F.expr(f"array({counts})")


def lookup(values, index: Column) -> Column:
    """Constant table lookup by 0-based position."""
    return F.get(F.expr(array_text(values)), index)


def det_type(det: Column) -> Column:
    return lookup([t for t, _, _ in C.ENTITY_PATTERNS], det)


def det_category(det: Column) -> Column:
    return lookup([C.ENTITY_TYPES[t][0] for t, _, _ in C.ENTITY_PATTERNS], det)


def det_label(det: Column) -> Column:
    return lookup([C.ENTITY_TYPES[t][1] for t, _, _ in C.ENTITY_PATTERNS], det)


def det_confidence(det: Column) -> Column:
    return lookup([entity_confidence(t) for t, _, _ in C.ENTITY_PATTERNS], det)


def det_explanation(det: Column) -> Column:
    return lookup(["Detected via " + d for _, d, _ in C.ENTITY_PATTERNS], det)
