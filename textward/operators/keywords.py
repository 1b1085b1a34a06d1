"""Keyword rules of many tenants in one pass over the texts.

A policy of a tenant is a row of a table, not a branch of an expression: all keywords form one automaton
(Aho-Corasick), which finds every keyword of a text in time proportional to the text, however many there are.  Rules
are numbers until the end, and each text's are sorted and told apart as such.  The plan does not grow with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords and their characters in one automaton; bounds what is broadcast at once.  More rules make more automata, each
#: of which sees every text.
MOST_KEYWORDS, MOST_CHARACTERS = 200_000, 4_000_000
#: Keywords found that are turned into rules at once.
HITS = 50_000

ACTIONS = ("block", "redact", "escalate", "alert")
FIRED = "array<struct<rule_id:string,action:string>>"

#: (rule id, action)
Rule = tuple[str | None, str | None]


def _place(rule: Rule) -> tuple:
    """Where Spark sorts a rule: nulls first, strings by code point."""
    return tuple(x for value in rule for x in (value is not None, value or ""))


class _Block(NamedTuple):
    """Some rules: what gives the numbers of keywords, and the numbers of the rules of a tenant and keyword.

    ``single`` has the keywords of one character, which are found too often to be reported one by one, the automaton the
    others.  ``keys`` are the different ``tenant number * size + keyword number``, sorted; those of ``keys[i]`` own the
    rules from ``starts[i]`` to ``starts[i + 1]``.
    """

    single: dict[str, int]
    automaton: object
    size: int
    keys: np.ndarray
    starts: np.ndarray
    rules: np.ndarray

    def found(self, text: str) -> set[int]:
        out = {n for _, n in self.automaton.iter(text)} if self.automaton else set()
        if self.single:
            out.update(self.single[c] for c in self.single.keys() & set(text))
        return out

    def owned(self, text: np.ndarray, tenant: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and the numbers of their rules, from texts, their tenants' numbers and their keywords."""
        wanted = tenant * self.size + hits
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        held = self.keys[at] == wanted
        text, at = text[held], at[held]
        count = self.starts[at + 1] - self.starts[at]
        first = np.repeat(self.starts[at] - (np.cumsum(count) - count), count)
        return np.repeat(text, count), self.rules[first + np.arange(len(first))]


def _blocks(rows: list[tuple[str, int, int]]) -> Iterator[_Block]:
    """Rows of keyword, tenant number and rule number, in blocks of bounded size; a keyword may lie in several."""
    import ahocorasick  # only where tenant rules are evaluated

    block: list[tuple[str, int, int]] = []
    size = 0
    for i, row in enumerate(rows):
        block.append(row)
        size += len(row[0])
        if i + 1 == len(rows) or len(block) == MOST_KEYWORDS or size + len(rows[i + 1][0]) > MOST_CHARACTERS:
            words = {word: n for n, word in enumerate(dict.fromkeys(word for word, _, _ in block))}
            single = {word: n for word, n in words.items() if len(word) == 1}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for word, n in words.items():
                if word not in single:
                    automaton.add_word(word, n)
            automaton.make_automaton()
            key = np.array([tenant * len(words) + words[word] for word, tenant, _ in block], np.int64)
            order = np.argsort(key, kind="stable")
            keys, starts = np.unique(key[order], return_index=True)
            yield _Block(single, automaton if len(automaton) else None, len(words), keys, np.append(starts, len(block)),
                         np.array([rule for _, _, rule in block], np.int64)[order])
            block, size = [], 0


def _matcher(df: DataFrame, rules: list[tuple[str, str | None, Rule]]):
    """A function of texts and tenants: the rules that fire, each once, sorted."""
    every = sorted({rule for _, _, rule in rules}, key=_place)
    number = {rule: n for n, rule in enumerate(every)}
    tenants = {name: n for n, name in enumerate(dict.fromkeys([None, *(tenant for _, tenant, _ in rules)]))}
    context = df.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in _blocks([(word, tenants[t], number[rule]) for word, t, rule in rules])]
    ids, actions = zip(*every, strict=True)
    known = context.broadcast((tenants, pa.StructArray.from_arrays(
        [pa.array(ids, pa.string()), pa.array(actions, pa.string())], ["rule_id", "action"])))

    @F.arrow_udf(FIRED)
    def fired(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        numbers, table = known.value
        parts = [b.value for b in blocks]

        def owned(hits: list[list[tuple[int, set[int]]]], owner: np.ndarray) -> np.ndarray:
            """``text * rules + rule`` of the texts with these keywords, by block, each once and sorted."""
            out = []
            for block, found in zip(parts, hits, strict=True):
                size = [len(h) for _, h in found]
                text = np.repeat(np.array([i for i, _ in found], np.int64), size)
                flat = np.fromiter((x for _, h in found for x in h), np.int64, sum(size))
                tenant = owner[text]
                for who in (np.zeros_like(tenant), tenant):
                    held = who >= 0
                    at, rule = block.owned(text[held], who[held], flat[held])
                    out.append(at * len(table) + rule)
            pairs = np.sort(np.concatenate(out))
            return pairs[np.diff(pairs, prepend=-1) > 0]

        for texts, names in batches:
            owner = np.array([numbers.get(name, -1) for name in names.to_pylist()], np.int64)
            packed, size = [np.zeros(0, np.int64)], 0
            hits: list[list[tuple[int, set[int]]]] = [[] for _ in parts]
            for i, text in enumerate(texts):
                text = text.as_py() or ""
                for block, found in zip(parts, hits, strict=True):
                    found.append((i, block.found(text)))
                    size += len(found[-1][1])
                if size > HITS:
                    packed.append(owned(hits, owner))
                    hits, size = [[] for _ in parts], 0
            packed.append(owned(hits, owner))
            pairs = np.concatenate(packed)
            bounds = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(table))
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), table.take(pa.array(pairs % len(table))))

    return fired


def keyword_rules(df: DataFrame, rules: DataFrame, text: str = "text", tenant: str = "tenant_id") -> DataFrame:
    """Append ``fired`` (rule id and action, by rule id) and ``keyword_action``, the most restrictive action.

    ``rules`` has ``rule_id, tenant_id, keyword, action``; a rule without a tenant holds for all, also for texts
    without one.  A keyword is found anywhere in the text, upper and lower case alike; null and empty keywords and
    null texts find nothing.  A rule with several keywords fires once.
    """
    plain = rules.select(F.col("rule_id").cast("string"), F.col("tenant_id").cast("string"),
                         F.lower("keyword").alias("keyword"), "action").filter(F.length("keyword") > 0).distinct()
    lowered, own = F.lower(F.col(f"`{text}`")), F.col(f"`{tenant}`").cast("string")
    known = [(r["keyword"], r["tenant_id"], (r["rule_id"], r["action"])) for r in plain.toLocalIterator()]
    fired = _matcher(df, known)(lowered, own) if known else F.array().cast(FIRED)
    action = F.lit("allow")
    for name in reversed(ACTIONS):
        action = F.when(F.array_contains(F.col("fired.action"), name), name).otherwise(action)
    return df.withColumn("fired", fired).withColumn("keyword_action", action)
