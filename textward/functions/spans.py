"""Match positions as native array expressions.

``regexp_extract_all`` and ``split`` over the same pattern interleave exactly,
so running lengths of gaps and matches give code-point offsets without a UDF.
None of the catalogue's patterns can match the empty string, which is what
makes the reconstruction valid.

Expressions generated from the pattern tables are written as SQL text and
parsed once by Spark; building them call by call from Python would take longer
than many of the queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware flags: multi-line, dot-all and plain case-insensitive tables.
MULTILINE, DOTALL, PLAIN = "(?imuU)", "(?isuU)", "(?iuU)"


def literal(value) -> str:
    """A Python value as Spark SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_text(values) -> str:
    return "array(" + ", ".join(literal(v) for v in values) + ")"


def rlike_text(text: str, regex: str) -> str:
    return f"{text} RLIKE {literal(regex)}"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that a fold adds to one array, so that growing it copies no more than these.
BLOCK = 256


def scan(items: Column, state: Column, kind: str, step, emit) -> Column:
    """``struct<state, out>``: the state after all items, and what ``emit(state, item)`` gave before each step.

    Items are folded in blocks, each with its own short array; one array that grows by every item would be copied
    as often.
    """
    def pair(value: Column, out: Column) -> Column:
        return F.struct(value.alias("state"), out.alias("out"))

    def of_block(xs: Column, acc: Column, i: Column) -> Column:
        inner = F.aggregate(
            F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)), pair(acc["state"], F.array().cast(f"array<{kind}>")),
            lambda a, x: pair(step(a["state"], x), F.concat(a["out"], F.array(emit(a["state"], x)))))
        return let(inner, lambda a: pair(a["state"], F.concat(acc["out"], F.array(a["out"]))))

    return let(items, lambda xs: F.aggregate(
        F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")))
        .otherwise(F.array().cast("array<int>")),
        pair(state, F.array().cast(f"array<array<{kind}>>")),
        lambda acc, i: of_block(xs, acc, i),
        lambda acc: pair(acc["state"], F.flatten(acc["out"]))))


def matches(text: Column, regex: str) -> Column:
    """All matched substrings, left to right."""
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def spans_text(text: str, regex: str, fields: dict | None = None, when: str | None = None) -> str:
    """SQL text of ``array<struct<fields..,start,end,value>>`` over all matches of one pattern.

    ``text`` is SQL text, ``fields`` are constant leading fields, and nothing is
    extracted where ``when`` (default: the pattern occurs) does not hold.
    Offsets are 0-based and end-exclusive.
    """
    fields = fields or {}
    constant = "".join(f"{literal(k)}, {literal(v)}, " for k, v in fields.items())
    types = {str: "string", int: "int", float: "double"}
    head = "".join(f"{k}:{types[type(v)]}," for k, v in fields.items())
    array_type = f"array<struct<{head}start:int,end:int,value:string>>"
    begin = "acc.pos + length(z.`1`)"
    end = f"{begin} + length(z.`0`)"
    pattern = literal(regex)
    return f"""CASE WHEN {when or rlike_text(text, regex)} THEN get(transform(array(
      arrays_zip(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1))), zs -> aggregate(
        sequence(0, CAST((size(zs) - 1) div {BLOCK} AS INT)),
        named_struct('pos', 0, 'out', CAST(array() AS array<{array_type}>)),
        (done, i) -> get(transform(array(aggregate(slice(zs, i * {BLOCK} + 1, {BLOCK}),
          named_struct('pos', done.pos, 'out', CAST(array() AS {array_type})),
          (acc, z) -> CASE WHEN z.`0` IS NULL THEN acc ELSE named_struct('pos', {end}, 'out', concat(acc.out,
            array(named_struct({constant}'start', {begin}, 'end', {end}, 'value', z.`0`)))) END)),
          b -> named_struct('pos', b.pos, 'out', concat(done.out, array(b.out)))), 0),
        done -> flatten(done.out))), 0) ELSE CAST(array() AS {array_type}) END"""


def replace_each(text: Column, values: Column, token: str) -> Column:
    """Replace every occurrence of each value in turn by the token."""
    return F.aggregate(values, text, lambda acc, v: F.replace(acc, v, F.lit(token)))


# ------------------------------------------------------------------ prefilters
def _split_top(regex: str) -> tuple[list[str], int]:
    """Alternatives of a pattern up to its end or an unmatched ``)``, and that position."""
    parts, start, depth, i = [], 0, 0, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i += 2 if regex[i + 1] in "^]" else 1
            while regex[i] != "]":
                i += 2 if regex[i] == "\\" else 1
        elif c == "(":
            depth += 1
        elif c == ")":
            if depth == 0:
                break
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(regex[start:i])
            start = i + 1
        i += 1
    return [*parts, regex[start:i]], i


def leading_literals(regex: str) -> tuple[str, ...] | None:
    """Literals of which any match must begin with one, or None where there is no such set."""
    found: list[str] = []
    for part in _split_top(regex)[0]:
        part = part.removeprefix(r"\b")
        group = 3 if part.startswith("(?:") else 1 if part.startswith("(") and not part.startswith("(?") else 0
        if group:
            _, end = _split_top(part[group:])
            if part[group + end + 1:group + end + 2] in ("?", "*", "{"):
                return None
            inner = leading_literals(part[group:group + end])
            if inner is None:
                return None
            found += inner
            continue
        run, i = "", 0
        while i < len(part):
            c, width = part[i], 1
            if c == "\\" and i + 1 < len(part) and not part[i + 1].isalnum():
                c, width = part[i + 1], 2
            elif c in "\\.^$*+?{}[]|()":
                break
            if part[i + width:i + width + 1] in ("?", "*", "{"):
                break
            run, i = run + c, i + width
        if not run:
            return None
        found.append(run)
    return tuple(dict.fromkeys(found))


def guarded_rlike(text: str, regex: str, flags: str, folded: str | None = None) -> str:
    """SQL text of a regex test behind a byte search for its leading literals.

    Case-insensitive patterns need the ``folded`` text column; without one, or
    without leading literals, the regular expression runs unguarded.
    """
    test = rlike_text(text, flags + regex)
    literals = leading_literals(regex)
    insensitive = "i" in flags
    hay = folded if insensitive else text
    if literals is None or hay is None:
        return test
    found = " OR ".join(f"contains({hay}, {literal(x.lower() if insensitive else x)})" for x in literals)
    return f"(({found}) AND {test})"
