"""URL rules and a blocked Bloom filter before an exact join with listed URLs; DataFrame functions only.

The filter is an array of 512-bit blocks, eight 64-bit words each.  A listed URL sets one bit in every word of one
block.  The number of blocks is a parameter, so the broadcast filter has the same bound however long the list is: a
longer list makes it let more URLs pass, and the hash join with the exact list decides about those.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the filter, a power of two: 64 bytes each, 4 MB at most.
BLOCKS = 1 << 16
WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``action`` for a host, its subdomains, and paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: no scheme, query or fragment, no leading ``www.``, no slash at the end.

    Null for an empty host."""
    plain = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))
    return F.when(host != "", plain)


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits (of equals, the one with the longer host), or nulls."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def _block(url: Column, blocks: int) -> Column:
    return F.xxhash64(url).bitwiseAND(F.lit(blocks - 1))


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit("bits"))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom_filter(listed: DataFrame, url: str = "canonical", blocks: int = BLOCKS) -> DataFrame:
    """One row for each block that holds a bit: ``block``, ``w0`` to ``w7``."""
    c = F.col(url)
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).alias(f"w{i}")
             for i, b in enumerate(_bits(c))]
    return listed.filter(c.isNotNull()).groupBy(_block(c, blocks).alias("block")).agg(*words)


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, key: str = "page_id", url: str = "url",
          otherwise: str = "allow", found: str = "block", blocks: int = BLOCKS) -> DataFrame:
    """Verdict of every row: ``key, host, path, rule, verdict, listed``.

    ``listed`` has a column ``canonical``; repeated and null entries count once and not at all.  A rule that fits
    decides; else the verdict is ``found`` for a listed URL and ``otherwise`` for the rest.  A null URL, or one
    without ``://``, has an empty host and path and is not listed.  Repeated rows are each judged; other columns of
    ``pages`` play no part, whatever their names.
    """
    if blocks & (blocks - 1) or blocks > BLOCKS:
        raise ValueError(f"blocks is a power of two up to {BLOCKS}")
    split = pages.select(F.col(f"`{key}`").alias("_key"), host_of(F.col(f"`{url}`")).alias("host"),
                         path_of(F.col(f"`{url}`")).alias("path"))
    text, action = rule_of(rules, F.col("host"), F.col("path"))
    named = split.select("*", text.alias("rule"), action.alias("_action"),
                         canonical(F.col("host"), F.col("path")).alias("canonical"))
    exact = listed.select("canonical").filter(F.col("canonical").isNotNull()).distinct()
    probed = named.withColumn("block", _block(F.col("canonical"), blocks)) \
        .join(F.broadcast(bloom_filter(exact, blocks=blocks)), "block", "left")
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("canonical"))):
        hit &= F.call_function("shiftright", F.col(f"w{i}"), b).bitwiseAND(F.lit(1)) == 1
    possible = F.coalesce(F.col("canonical").isNotNull() & F.col("w0").isNotNull() & hit, F.lit(False))
    kept = ["_key", "host", "path", "rule", "_action"]
    clear = probed.filter(~possible).select(*kept, F.lit(False).alias("listed"))
    checked = probed.filter(possible).select(*kept, "canonical") \
        .join(exact.withColumn("listed", F.lit(True)), "canonical", "left") \
        .select(*kept, F.coalesce("listed", F.lit(False)).alias("listed"))
    verdict = F.coalesce("_action", F.when(F.col("listed"), found).otherwise(otherwise))
    return clear.unionByName(checked).select(
        F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "listed")
