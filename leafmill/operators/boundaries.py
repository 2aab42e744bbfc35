"""Spaces that were lost between words, found again: the likeliest words, by how often a table has them, that make up a run of letters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: runs of this many ASCII letters may be several words.
JOINED = re.compile("[A-Za-z]{7,}")
#: Words that are learned, at most, and their greatest length; a letter that is in no word costs this much beyond a word seen once.
MOST, LONGEST, STRANGE = 50_000, 24, 10.0


def word_costs(texts: DataFrame, text: str, most: int = MOST) -> dict[str, float]:
    """The `most` frequent words of a column, with minus the logarithm of their share. All texts are counted; what comes to the
    driver is bounded by `most` and LONGEST. Of words equally frequent the first ones count. Null texts have no words."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = words.filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.orderBy(F.desc("n"), "word").limit(most).collect()
    return {r.word: math.log(total / r.n) for r in rows}


class Trie:
    """Words letter by letter: for each node its children and, where a word ends, its cost."""

    def __init__(self, costs: Mapping[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.cost: list[float | None] = [None]
        self.strange = max(costs.values(), default=0.0) + STRANGE
        for word, cost in costs.items():
            node = 0
            for letter in word:
                at = self.children[node].get(letter)
                if at is None:
                    at = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.cost.append(None)
                node = at
            self.cost[node] = cost

    def split(self, letters: str) -> list[int]:
        """Where the words of the cheapest division end; of equal ones that whose last word is the longest, and so on forward."""
        n = len(letters)
        best, came = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            base, node = best[i], 0
            for j in range(i, n):
                at = self.children[node].get(letters[j])
                if at is None:
                    break
                node = at
                cost = self.cost[node]
                if cost is not None and base + cost < best[j + 1]:
                    best[j + 1], came[j + 1] = base + cost, i
            if base + self.strange < best[i + 1]:
                best[i + 1], came[i + 1] = base + self.strange, i
        ends = []
        while n:
            ends.append(n)
            n = came[n]
        return ends[::-1]

    def restored(self, text: str) -> str:
        def one(found: re.Match) -> str:
            run = found.group()
            if run.isupper():
                return run
            ends = self.split(run.lower())
            return " ".join(run[a:z] for a, z in zip([0, *ends], ends))

        return JOINED.sub(one, text)


def restore(text: Column, costs: Mapping[str, float]) -> Column:
    """A text with spaces put into its runs of seven ASCII letters or more where the words of `costs` make them up more cheaply;
    runs in capitals stay. Null stays null."""
    kept: dict[str, Trie] = {}

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = kept.setdefault("trie", Trie(costs))
        for texts in batches:
            yield texts.map(lambda t: t if t is None else trie.restored(t), na_action="ignore")

    return run(text)


def cuts(x: Column) -> Column:
    """How many characters but spaces stand before each space of a text."""
    sizes = F.transform(F.split(x, " "), F.length)
    sums = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + n))
    return F.array_distinct(F.slice(sums, F.lit(1), F.greatest(F.size(sums) - 1, F.lit(0))))


def boundary_measures(text: Column, glued: Column, restored: Column) -> tuple[Column, Column]:
    """Of the spaces of text that glued lost: the share that restored has again; and of the spaces that restored adds, the share
    that text has. 1 where there are none."""
    lost, added = F.array_except(cuts(text), cuts(glued)), F.array_except(cuts(restored), cuts(glued))
    both = F.size(F.array_intersect(lost, added))
    of = lambda a: F.when(F.size(a) == 0, 1.0).otherwise(both / F.size(a))
    return of(lost), of(added)
