"""Quality rules: statistics of whole texts and a decision list learned from labelled ones.

The learner is sequential covering. It grows a conjunction of threshold conditions on two thirds of the uncovered sample
by information gain, prunes its last conditions on the other third, keeps it while it is right there often enough, removes
what it covers and starts again. The rules, in order, become one Spark CASE expression; the default is to keep.

Nulls and ties: a null text has no words, so its statistics are 0 and it fails the base; a document without a label, or
with a null one, is judged but not learned from; a document with contradictory labels counts as the lower one; without
usable labels, or with one class only, the list is empty and keeps everything. Equal gains go to the first statistic in
FEATURES and the lowest threshold. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_names, table

_WS = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = (*BASE, "n_lines", "n_unique", "n_digits", "n_commas")
#: What rules look at: a statistic, or its share of another one, so that a rule means the same for short and long texts.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "unique_share": ("n_unique", "n_words"),
    "digits_per_word": ("n_digits", "n_words"),
    "commas_per_word": ("n_commas", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
#: Rows of the sample that the list is learned from, at most: those with the smallest hashes of their id.
SAMPLE = 20_000
WINDOW = 5


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window found twice or more."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    if count <= 100_000:
        windows = list(zip(*(words[i:] for i in range(n))))
        if len(seen := set(windows)) == count:
            return 0
        often = {w for w, k in Counter(windows).items() if k > 1} if len(seen) > 1 else seen
        hit = np.fromiter((w in often for w in windows), bool, count)
    else:  # numbers instead of tuples keep memory small
        number: dict[bytes, int] = {}
        one = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        ids = one
        for i in range(1, n):
            ids = np.unique(ids[: len(one) - i] * len(number) + one[i:], return_inverse=True)[1]
        hit = np.bincount(ids)[ids] > 1
    ends = np.cumsum(np.bincount(np.flatnonzero(hit), minlength=len(words))) if hit.any() else None
    if ends is None:
        return 0
    back = np.concatenate([np.zeros(n, np.int64), ends])
    return int(((ends - back[: len(ends)]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_WS)]
    return (
        len(words),
        len(text) - sum(map(text.count, _WS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        sum(map(text.count, "0123456789")),
        text.count(","),
    )


def _stats(text: str, drop: bool, prefix: str):
    def run(batches):
        for b in batches:
            cols = np.array([statistics(t.as_py()) for t in b.column(text)], np.int64).reshape(-1, len(STATS))
            rest = [i for i, n in enumerate(b.schema.names) if not (drop and n == text)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *(pa.array(cols[:, i]) for i in range(len(STATS)))], names=[*(b.schema.names[i] for i in rest), *(prefix + x for x in STATS)])

    return run


def with_statistics(docs: DataFrame, text: str = "text", drop: bool = False, prefix: str = "") -> DataFrame:
    """docs with STATS under prefixed names; drop leaves the text out."""
    schema = T.StructType([*(f for f in docs.schema.fields if not (drop and f.name == text)), *(T.StructField(prefix + x, T.LongType()) for x in STATS)])
    return docs.mapInArrow(_stats(text, drop, prefix), schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        part, whole = FEATURES[self.feature]
        x = F.col(prefix + part).cast("double")
        x = x / F.greatest(F.col(prefix + whole), F.lit(1)) if whole else x
        return x >= F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def features(stats: np.ndarray) -> np.ndarray:
    """A column for each of FEATURES from rows of STATS."""
    at = {x: i for i, x in enumerate(STATS)}
    return np.stack([stats[:, at[p]] / (np.maximum(stats[:, at[w]], 1) if w else 1) for p, w in FEATURES.values()], axis=1).astype(float)


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> Rule:
    """Add the condition with the best gain until only bad rows are covered."""
    rule: list[Condition] = []
    live = np.ones(len(x), bool)
    while len(rule) < most and (live & ~bad).any():
        xs, bs = x[live], bad[live]
        was = np.log2(max(bs.mean(), 1e-12))
        best = (0.0, None)
        for j, name in enumerate(FEATURES):
            order = np.argsort(xs[:, j], kind="stable")
            v, p = xs[order, j], np.cumsum(bs[order])
            last = np.flatnonzero(np.append(v[1:] != v[:-1], True))[:-1]  # a cut lies after each of these
            if not len(last):
                continue
            cut = (v[last] + v[last + 1]) / 2
            for above in (False, True):
                pos = p[-1] - p[last] if above else p[last]
                all_ = len(v) - last - 1 if above else last + 1
                gain = pos * (np.log2(np.maximum(pos, 1e-12) / all_) - was)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float(cut[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x)
    return tuple(rule)


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 5, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.8, least: int = 3) -> list[Rule]:
    """The ordered rules that reject, from features x of rows that are bad or not."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    part = rng.random(len(x)) < 2 / 3
    while len(rules) < most_rules and (bad & part).sum() >= least and (bad & ~part).any():
        rule = _grow(x[part], bad[part], most_conditions)

        def worth(r: Rule) -> tuple[float, float]:
            hit = _covered(r, x[~part])
            p, n = int((hit & bad[~part]).sum()), int((hit & ~bad[~part]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        hit = _covered(rule, x)
        if not rule or (worth(rule)[0] + 1) / 2 < precision or hit.sum() == 0:
            break
        rules.append(rule)
        x, bad, part = x[~hit], bad[~hit], part[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most `sample` labelled rows, those with the smallest hashes of their key; their ids are broadcast."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.min(label).alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select("__key", "__label", "__text")
    got = with_statistics(rows, "__text", drop=True).orderBy(F.xxhash64("__key"), *STATS).limit(sample).toPandas()
    return learn(features(got[list(STATS)].to_numpy()), got["__label"].to_numpy() == 0) if len(got) else []


def rejected(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one conditional expression: the number of the first rule that holds, from 1, else null."""
    out = None
    for i, rule in enumerate(rules, 1):
        both = rule[0].column(prefix)
        for c in rule[1:]:
            both = both & c.column(prefix)
        out = F.when(both, i) if out is None else out.when(both, i)
    return F.lit(None).cast("int") if out is None else out


def base_failed(prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * words)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, STATS, base_failed, rule (the number of the rule that rejects, or null) and kept for each row of docs."""
    rules = fit(docs, labels, text, key)
    stats = with_statistics(docs.select(key, text), text, drop=True)
    return stats.select(key, *STATS, base_failed().alias("base_failed"), rejected(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that the base and the learned list keep, with their columns, which may have any names. Nothing is shuffled."""
    rules = fit(docs, labels, text, key)
    plain, (own,) = plain_names(docs, text)
    judged = with_statistics(plain, own, prefix="__q_")
    return judged.filter(~base_failed("__q_") & rejected(rules, "__q_").isNull()).select(plain.columns).toDF(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "rule")
