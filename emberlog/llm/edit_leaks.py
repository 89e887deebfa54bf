"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may occur with up to ``k = floor(RATE * m)`` edits.  It is split into ``k + 1`` pieces; any such
occurrence holds at least one piece unchanged.  All pieces of a block of items are searched for at once in each whole text; a
hit names a window in which the item can lie, and Myers' bit-parallel distance decides.

Text and items are compared as lower-cased words joined by one blank.  NULL and empty texts hold nothing, and an item without
a word is found nowhere; repeated items are searched once, equal texts under several ids are reported for each.  Items are
a stated query set: they are taken in blocks of about ``BLOCK`` characters, each held by all tasks at once, and every block meets
every row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import table

#: Edits allowed for each character of an item.
RATE = 0.05
#: Characters of items held at once.
BLOCK = 4_000_000
WORD = re.compile(r"[^\W_]+")
FOUND = "array<struct<item_id:bigint,distance:int,start:bigint,stop:bigint>>"


def normalised(text: str | None) -> str:
    return " ".join(WORD.findall(text or "")).lower()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces of nearly equal length, with their starts."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of ``text``, and where the first such part ends.

    Columns of the distance matrix are kept as bit vectors of +1 and -1 steps.  ``anchored``: the part begins at 0.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = ((right_up << 1) | anchored) & full
        right_down = (right_down << 1) & full
        up = right_down | (full & ~((eq | down) | right_up))
        down = right_up & (eq | down)
        if score < best:
            best, end = score, j
    return best, end


def whole_words(text: str, pattern: str, lo: int, hi: int) -> Iterator[int]:
    """Where ``pattern`` stands in ``text[lo:hi]`` with no letter or digit next to its own first or last."""
    at = text.find(pattern, lo, hi)
    while at >= 0:
        end = at + len(pattern)
        inside = (at > 0 and text[at - 1].isalnum() and pattern[0].isalnum()) or (end < len(text) and text[end].isalnum() and pattern[-1].isalnum())
        if not inside:
            yield at
        at = text.find(pattern, at + 1, hi)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = [(i, p, int(rate * len(p)), masks(p), masks(p[::-1])) for i, p in items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, pattern, budget, _, _) in enumerate(self.items):
            for at, piece in pieces(pattern, budget):
                where[piece].append((n, at + len(piece) - 1))
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item hit, the ranges of ``text`` it can lie in; ranges that overlap are one."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, places in self.automaton.iter(text):
            for n, at in places:
                starts[n].add(end - at)
        out = {}
        for n, found in starts.items():
            _, pattern, budget, _, _ = self.items[n]
            merged: list[list[int]] = []
            for s in sorted(found):
                lo, hi = max(0, s - budget), min(len(text), s + len(pattern) + budget)
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = hi
                else:
                    merged.append([lo, hi])
            out[n] = merged
        return out

    def __call__(self, raw: str | None) -> list[dict]:
        """The best occurrence of each item within its budget, as code points of the text as given."""
        text = normalised(raw)
        if self.empty or not text:
            return []
        out, spans = [], None
        for n, ranges in self.windows(text).items():
            item, pattern, budget, peq, reverse = self.items[n]
            best = None
            if not budget:  # a short item counts as words of the text only
                at = next((s for lo, hi in ranges for s in whole_words(text, pattern, lo, hi)), None)
                ranges, best = [], at if at is None else (0, at, at + len(pattern))
            for lo, hi in ranges:
                distance, end = myers(peq, len(pattern), text[lo:hi])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, lo, lo + end)
            if best is None:
                continue
            distance, lo, end = best
            _, back = myers(reverse, len(pattern), text[lo:end][::-1], anchored=True)
            spans = spans or [m.span() for m in WORD.finditer(raw)]
            first = text.count(" ", 0, end - back + 1 if text[end - back : end - back + 1] == " " else end - back)
            last = text.count(" ", 0, end) - (text[end - 1] == " ")
            out.append({"item_id": item, "distance": distance, "start": spans[first][0], "stop": spans[last][1]})
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["start"]))


def _finder(items: list[tuple[int | None, str]], rate: float):
    held: list[Matcher] = []

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(items, rate))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        return pa.array([held[0](t.as_py()) for t in texts], kind)

    return find


def finders(items: DataFrame, rate: float = RATE, block: int = BLOCK) -> list:
    """A column function ``text -> occurrences`` for each block of ``items (item_id, text)``."""
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // block + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    out = []
    for i in range(n):
        rows = wanted.filter(part == i).collect()  # about `block` characters
        found = sorted({(r["item_id"], p) for r in rows if (p := normalised(r["text"]))}, key=lambda x: (x[1], x[0] is None, x[0] or 0))
        out.append(_finder(found, rate))
    return out


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """A row for each row of ``docs`` and item found in it: ``doc_id, item_id, distance, start, stop`` (best occurrence)."""
    out = None
    for find in finders(items, rate, block):
        rows = docs.select("doc_id", F.explode(find(F.col("text"))).alias("found")).select("doc_id", "found.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _clean(found: Column) -> Column:
    return F.size(found) == 0


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"))
    for find in finders(items, rate, block):
        rows = rows.filter(_clean(find(F.col("row.text"))))
    return rows.select("row.*")


def op4_pigeonhole_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
