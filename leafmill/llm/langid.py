"""Language identification by cross-parsing entropy against suffix automata.

Each language has the suffix automaton of a bounded sample of its labelled texts. A text is parsed from left to right into
the longest phrases that occur somewhere in that sample; phrases * log(sample length) / text length estimates the cross
entropy, and the language that needs least wins. Parsing is a walk over the automaton's transitions that starts again
at its root wherever none is left. The parse of a text is one walk over all of it. numpy walks its blocks of BLOCK symbols
side by side, at first each from the root; then each block is walked again from the state in which the one before it
ends, until the walk comes to the state it had at that symbol before, from where on nothing changes; and so on, while ends of blocks change.

The symbols are letters in lower case; all else is a space, and runs of spaces are one. Only the text is looked at. What is
learned is bounded: TEXTS texts of a language and SYMBOLS symbols of all of them together, so that a single long text is learned up to there.

Nulls and ties: a null text, or one without a letter, is `und` with score 0; with no labelled texts all are `und`. Equal
entropies go to the language that comes first by code point. Rows with a null language or text are not learned from.
Repeated rows get equal results. Other columns are not read and may have any names. score is 1 minus the winner's entropy over the runner-up's (1 if there is none).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Texts sampled for a language, those with the smallest hashes of their id, and symbols of them that are learned, at most.
TEXTS, SYMBOLS = 60, 40_000
#: Most frequent symbols, whose transitions are a dense table; those of the samples' other letters are found by bisection.
ALPHABET = 127
BLOCK, BLOCKS = 512, 4_096  # symbols, and blocks walked at once
#: Code points that may be letters.
POINTS = 0x40000


def _letters() -> np.ndarray:
    """For every code point below POINTS its lower-case letter, or 32."""
    out = np.full(POINTS, 32, np.int32)
    for i in range(POINTS):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    return _LETTERS


def normal(text: str) -> np.ndarray:
    """Code points of letters in lower case; runs of others are one space, also at either end."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = letters()[np.minimum(points, POINTS - 1)]
    return folded[np.append(True, (folded[1:] != 32) | (folded[:-1] != 32))]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of a suffix automaton; state 0 is the root. The symbol -1 separates texts."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        if c < 0:
            last = 0
            continue
        if (q := nxt[last].get(c)) is not None:  # a known string, after a separator
            if length[q] == length[last] + 1:
                last = q
                continue
            clone = len(nxt)
            nxt.append(nxt[q].copy())
            link.append(link[q])
            length.append(length[last] + 1)
            link[q] = clone
            p = last
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            last = clone
            continue
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nxt


class Model:
    """The automata of all languages as one table of transitions: [state, symbol] is twice the next state, plus 1 if a phrase begins with the symbol.

    Every letter of the samples has its own number, frequent ones first; all other letters share the last number, which no
    automaton knows. Symbols from `dense` on are not in the table: rare[language] has their transitions as sorted keys
    (row of the table * letters + symbol) and values, and for each symbol what follows where a state has none."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        streams = {k: [normal(t) for t in v] for k, v in texts.items()}
        count = Counter()
        for v in streams.values():
            for x in v:
                count.update(dict(zip(*map(np.ndarray.tolist, np.unique(x, return_counts=True)))))
        known = sorted(count, key=lambda c: (-count[c], c))
        self.letters, self.dense = len(known), min(len(known), ALPHABET)
        self.width = self.dense + 1  # the last column is of symbols that no sample contains
        self.number = np.full(POINTS, len(known), np.int32)
        self.number[known] = np.arange(len(known))
        rows, self.roots, self.sizes, self.rare, at = [], [], [], [], 0
        for lang in self.languages:
            stream: list[int] = []
            for x in streams[lang]:
                stream += [*self.number[x[: max(0, SYMBOLS - len(stream))]].tolist(), -1]
                if len(stream) >= SYMBOLS:
                    break
            states = automaton(stream)
            t = np.full((len(states), self.width), -1, np.int64)
            keys, goes = [], []
            for i, d in enumerate(states):
                for c, q in d.items():
                    if c < self.dense:
                        t[i, c] = 2 * (q + at)
                    else:
                        keys.append((i + at) * self.width * self.letters + c)
                        goes.append(2 * (q + at) + (i == 0))
            begins = np.full(self.letters + 1, 2 * at + 1, np.int32)
            for c, q in states[0].items():
                begins[c] = 2 * (q + at) + 1
            order = np.argsort(np.array(keys, np.int64))
            self.rare.append((np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max), np.append(np.array(goes, np.int32)[order], np.int32(0)), begins))
            root = np.where(t[0] < 0, 2 * at, t[0])  # an unknown symbol is a phrase of its own
            t = np.where(t < 0, root | 1, t)
            t[0] |= 1
            rows.append(t.astype(np.int32))
            self.roots.append(at)
            self.sizes.append(max(2, len(stream)))
            at += len(states)
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)

    def _step(self, k: int, state: np.ndarray, s: np.ndarray, some: bool) -> np.ndarray:
        """Where symbols s lead from states, for language k; some: a symbol may be none of the table's."""
        if not some:
            return self.table[state + s]
        keys, goes, begins = self.rare[k]
        go = self.table[state + np.minimum(s, self.dense)]
        at = np.flatnonzero(s >= self.dense)
        wanted = state[at].astype(np.int64) * self.letters + s[at]
        wanted[s[at] == self.letters] = -1  # in no sample
        found = np.searchsorted(keys, wanted)
        go[at] = np.where(keys[found] == wanted, goes[found], begins[s[at]])
        return go

    def _walk(self, k: int, blocks: np.ndarray, lengths: np.ndarray, before: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block (a column of symbols, the longest first), and the state at its end. before: the
        column whose end a block goes on from, -1 for the root, -2 for the state carried."""
        size, n = blocks.shape
        root = self.roots[k] * self.width
        some = (blocks >= self.dense).any(axis=1) & (self.letters > self.dense)
        states, starts = np.empty((size, n), np.int32), np.zeros((size, n), bool)
        state = np.full(n, root, np.int32)
        live = np.searchsorted(-lengths, -np.arange(1, size + 1), side="right")
        for i in range(size):
            m = live[i]
            go = self._step(k, state[:m], blocks[i, :m], some[i])
            starts[i, :m] = go & 1
            state[:m] = states[i, :m] = (go >> 1) * self.width
        begun = np.full(n, root, np.int32)
        while True:
            begin = np.where(before >= 0, state[np.maximum(before, 0)], np.where(before == -2, carried, root)).astype(np.int32)
            at = np.flatnonzero(begin != begun)
            if not len(at):
                return starts.sum(axis=0), state
            begun, now = begin, begin[at]
            for i in range(size):
                m = int(np.searchsorted(at, live[i]))
                at, now = at[:m], now[:m]
                if not m:
                    break
                go = self._step(k, now, blocks[i, at], some[i])
                starts[i, at] = go & 1
                now = (go >> 1) * self.width
                other = now != states[i, at]
                at, now = at[other], now[other]
                states[i, at] = now
                ended = lengths[at] == i + 1
                state[at[ended]] = now[ended]

    def phrases(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text, for each language."""
        sizes = np.array([len(s) for s in symbols], np.int64)
        parts = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(symbols)), parts)
        total = np.zeros((len(self.languages), len(symbols)), np.int64)
        if not len(owner):
            return total
        place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(sizes) - sizes, parts) + place * BLOCK
        length = np.minimum(BLOCK, np.cumsum(sizes)[owner] - start)
        padded = np.concatenate([*symbols, np.zeros(BLOCK, np.int32)]).astype(np.int32)
        carried = [0] * len(self.languages)
        for lo in range(0, len(owner), BLOCKS):
            own = owner[lo : lo + BLOCKS]
            by = np.argsort(-length[lo : lo + BLOCKS], kind="stable")
            column = np.empty(len(by), np.int64)
            column[by] = np.arange(len(by))
            before = np.where(place[lo : lo + BLOCKS] > 0, np.append(-2, column[:-1]), -1)[by]
            lengths = length[lo : lo + BLOCKS][by]
            blocks = padded[start[lo : lo + BLOCKS][by][None, :] + np.arange(int(lengths[0]))[:, None]]
            for k in range(len(self.languages)):
                count, state = self._walk(k, blocks, lengths, before, carried[k])
                total[k] += np.bincount(own[by], count, len(symbols)).astype(np.int64)
                carried[k] = int(state[column[-1]])
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        symbols = [self.number[normal(t)] if t else np.zeros(0, np.int32) for t in texts]
        spaces = int(self.number[32])
        sizes = np.array([len(s) for s in symbols], np.int64)
        has = np.array([bool(len(s)) and bool((s != spaces).any()) for s in symbols])
        total = self.phrases(symbols)
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        entropy = total * np.log(self.sizes)[:, None] / np.maximum(sizes, 1)
        best = np.argmin(entropy, axis=0)
        two = np.sort(entropy, axis=0)[:2]
        score = 1 - two[0] / np.maximum(two[1], 1e-12) if len(two) > 1 else np.ones(len(texts))
        return [(self.languages[b], float(min(1.0, max(0.0, s)))) if h else ("und", 0.0) for b, s, h in zip(best, score, has)]


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("None")).cast("binary")), F.lit(5)) == 0


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """At most TEXTS texts for each language of the rows that aren't held out, as far as SYMBOLS go. Only their ids are ranked and broadcast.
    Rows without a text count for nothing; rows of one id are one text, the last by code point."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.filter(~held_out("key"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    ids = rows.select("key", "lang").withColumn("rank", rank).filter(F.col("rank") <= TEXTS).select(F.col("key").alias("id"), "rank")
    got = rows.join(F.broadcast(ids), F.col("key") == F.col("id")).groupBy("lang", "rank").agg(F.max(F.substring("text", 1, SYMBOLS)).alias("t")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["t"])
    return found


_MODEL: tuple | None = None


def identify(docs: DataFrame, texts: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score for each row. The sample is sent to the executors, each of whose workers builds the automata once."""
    spark = docs.sparkSession
    cut = {k: v[: next((i for i in range(1, len(v) + 1) if sum(map(len, v[:i])) >= SYMBOLS), len(v))] for k, v in texts.items()}
    sent = spark.sparkContext.broadcast(cut)

    def run(batches):
        global _MODEL
        if _MODEL is None or _MODEL[0] != sent.value:
            _MODEL = (sent.value, Model(sent.value))
        for b in batches:
            got: list[tuple[str, float]] = []
            held: list[str | None] = []
            room = 0
            for t in b.column(text):
                held.append(t.as_py())
                room += len(held[-1] or "")
                if room > 8_000_000:
                    got += _MODEL[1].predict(held)
                    held, room = [], 0
            got += _MODEL[1].predict(held)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, sample(docs)).withColumn("held_out", held_out("doc_id"))
