"""Benchmark decontamination (operator 11): an FM-index for each shard of training documents, searched for the benchmark's phrases.

A shard is some megabytes of documents within a task. Its words are numbered by the vocabulary of the phrases; a word that no
phrase has ends a string, and strings shorter than the shortest phrase are left out, for nothing can occur in them. The strings'
FM-index is searched backwards for all phrases at once, occurrences are located by sampled suffixes, and overlapping or touching
ones are merged into spans. Phrases come in blocks of at most about BLOCK words; a benchmark beyond one block takes a pass for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize, plain_names, table, utf8
from .fmindex import FmIndex

#: Words of a phrase; an item with fewer words is one phrase.
WINDOW = 10
#: Words of a block of phrases, which is sent to all executors.
BLOCK = 1 << 20
#: Words of an item that stay together; longer items are cut into overlapping parts.
PART = 1 << 16
#: A shard ends with this many bytes of text or this many words within strings.
SHARD_BYTES, SHARD_WORDS = 32 << 20, 1 << 20
_SLICE = 4 << 20

_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
FOUND = "id long, print long, n_words long, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def _parts(width: int):
    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            h, at = words.of_rows(data, offsets)
            out = []
            for item, a, z in zip(b.column("item").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                for p in range(a, max(z - width + 1, min(a + 1, z)), PART):
                    out.append((item, h[p : min(p + PART + width - 1, z)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["item", "words"])

    return run


class Phrases:
    """A block of phrases: their words' numbers, and the items (in the order of their names) that each one comes from."""

    def __init__(self, parts: list[tuple[str, bytes]], width: int):
        hashes = [np.frombuffer(x, np.uint64) for _, x in parts]
        self.vocabulary = words.Vocabulary(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))
        self.items = sorted({x for x, _ in parts})
        number = {x: i for i, x in enumerate(self.items)}
        rows, of = [], []
        for (item, _), h in zip(parts, hashes):
            s = self.vocabulary.number(h)
            if len(s) < width:
                s = np.append(s, np.zeros(width - len(s), s.dtype))
            w = np.lib.stride_tricks.sliding_window_view(s, width)
            rows.append(w)
            of.append(np.full(len(w), number[item], np.int64))
        every = np.concatenate(rows) if rows else np.zeros((0, width), np.int32)
        self.phrases, which = np.unique(every, axis=0, return_inverse=True)
        self.sizes = np.count_nonzero(self.phrases, axis=1)
        pairs = np.unique(which.reshape(-1).astype(np.int64) * max(len(self.items), 1) + (np.concatenate(of) if of else 0))
        self.item = pairs % max(len(self.items), 1)
        self.begin = np.searchsorted(pairs // max(len(self.items), 1), np.arange(len(self.phrases) + 1))
        self.shortest = int(self.sizes.min(initial=width))


class _Shard:
    """Documents held until their index is built."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.batches: list[tuple] = []
        self.symbols: list[np.ndarray] = []
        self.row: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.rows = self.bytes = self.kept = 0

    def add(self, ids: pa.Array, prints: pa.Array, text: pa.Array) -> None:
        data, offsets = utf8(text)
        counts = []
        for a, z in words.slices(offsets, _SLICE):
            h, at = words.of_rows(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            counts.append(np.diff(at))
            self._strings(self.phrases.vocabulary.number(h), at, self.rows + a)
        self.batches.append((ids, prints, np.concatenate(counts) if counts else np.zeros(0, np.int64)))
        self.rows += len(text)
        self.bytes += len(data)

    def _strings(self, s: np.ndarray, at: np.ndarray, row: int) -> None:
        known = np.append(s > 0, False)
        first = known[:-1].copy()
        first[1:] &= ~known[:-2]
        edge = at[:-1][at[:-1] < len(s)]
        first[edge] = known[edge]
        begin = np.flatnonzero(first)
        stop = ~known
        stop[edge] = True  # a string ends where the next row begins, too
        stops = np.flatnonzero(stop)
        end = stops[np.searchsorted(stops, begin, "right")]
        long = end - begin >= max(self.phrases.shortest, 1)
        begin, size = begin[long], (end - begin)[long]
        if not len(begin):
            return
        total = size + 1  # with the 0 that ends it
        o = np.cumsum(total) - total
        i = np.arange(int(total.sum())) - np.repeat(o, total)
        out = s[np.minimum(np.repeat(begin, total) + i, len(s) - 1)]
        out[o + size] = 0
        of = np.searchsorted(at, begin, "right") - 1
        self.symbols.append(out)
        self.row.append(np.repeat(row + of, total))
        self.word.append(np.repeat(begin - at[of], total) + i)
        self.kept += len(out)

    def found(self) -> tuple[np.ndarray, ...]:
        """Spans as row, first and last word; and row and item of each item found in a row."""
        none = np.zeros(0, np.int64)
        if not self.kept or not len(self.phrases.phrases):
            return none, none, none, none, none
        s, row, word = (np.concatenate(x) for x in (self.symbols, self.row, self.word))
        index = FmIndex(s)
        lo, hi = index.ranges(self.phrases.phrases, self.phrases.sizes)
        hit = np.flatnonzero(hi > lo)
        which, place = index.locate(lo[hit], hi[hit])
        which = hit[which]
        edge = np.zeros(len(s) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + self.phrases.sizes[which], -1)
        inside = np.cumsum(edge) > 0  # never at a 0, so spans of two strings don't touch
        turn = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        a, z = turn[::2], turn[1::2] - 1
        both = np.unique(row[place] * len(self.phrases.phrases) + which)
        r, p = both // len(self.phrases.phrases), both % len(self.phrases.phrases)
        n = self.phrases.begin[p + 1] - self.phrases.begin[p]
        item = self.phrases.item[np.repeat(self.phrases.begin[p] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        pairs = np.unique(np.repeat(r, n) * len(self.phrases.items) + item)
        return row[a], word[a], word[z], pairs // len(self.phrases.items), pairs % len(self.phrases.items)

    def emit(self):
        row, first, last, of, item = self.found()
        names = np.array(self.phrases.items, object)
        done = 0
        for ids, prints, counts in self.batches:
            n = len(counts)
            rows = np.arange(done, done + n + 1)
            s, i = np.searchsorted(row, rows), np.searchsorted(of, rows)
            some = slice(s[0], s[-1])
            spans = pa.StructArray.from_arrays([pa.array(first[some], pa.int64()), pa.array(last[some], pa.int64())], fields=list(_SPAN))
            items = pa.array(names[item[i[0] : i[-1]]].tolist(), pa.string())
            lists = [pa.ListArray.from_arrays(pa.array(x - x[0], pa.int32()), v) for x, v in ((s, spans), (i, items))]
            yield pa.RecordBatch.from_arrays([ids, prints, pa.array(counts, pa.int64()), *lists], names=["id", "print", "n_words", "spans", "items"])
            done += n


def _search(sent, every_row: bool):
    def run(batches):
        shard = _Shard(sent.value)
        for b in batches:
            shard.add(b.column("id"), b.column("print"), b.column("text"))
            if shard.bytes >= SHARD_BYTES or shard.kept >= SHARD_WORDS:
                yield from told(shard)
                shard = _Shard(sent.value)
        yield from told(shard)

    def told(shard):
        for b in shard.emit():
            if every_row:
                yield b
            else:
                yield b.filter(pa.compute.greater(pa.compute.list_value_length(b.column("items")), 0))

    import pyarrow.compute  # noqa: F401

    return run


def blocks(benchmark: DataFrame, text: str, key: str, width: int = WINDOW, block: int = BLOCK) -> list[DataFrame]:
    """The phrases' words in blocks of about `block` words: parts of items by their name, which may be null (told as an empty name)."""
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    parts = materialize(items.mapInArrow(_parts(width), "item string, words binary"), "phrases")
    total = parts.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    n = int(total // block) + 1
    return [parts.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i) for i in range(n)]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id", width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """id, print (a hash of the text), n_words, spans (first and last word of each merged stretch that is in phrases) and items
    (names of those with an occurring phrase, in order) for each row of docs. Null and empty texts have no words; rows are
    searched each by itself, so repeated rows get equal answers; items of one name are one item; an item without words is none."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text"))
    passes = []
    for i, part in enumerate(every := blocks(benchmark, item_text, item, width, block)):
        sent = spark.sparkContext.broadcast(Phrases([(r.item, bytes(r.words)) for r in part.distinct().collect()], width))
        passes.append(rows.mapInArrow(_search(sent, i == 0), FOUND))
    if len(every) == 1:
        return passes[0]
    more = passes[1].dropDuplicates(["id", "print"])
    for p in passes[2:]:
        more = more.unionByName(p.dropDuplicates(["id", "print"]))
    more = more.groupBy("id", "print").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
    more = materialize(more.withColumnsRenamed({"id": "__id", "print": "__print"}), "phrase-hits")
    both = passes[0].join(more, F.col("id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print")), "left")
    spans = F.concat("spans", F.coalesce("__spans", F.array().cast("array<struct<first:bigint,last:bigint>>")))
    names = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("__items", F.array().cast("array<string>")))))
    return both.select("id", "print", "n_words", merged(spans).alias("spans"), names.alias("items"))


def merged(spans) -> F.Column:
    """Spans in order, those that overlap or touch as one."""
    kind = "array<struct<first:bigint,last:bigint>>"
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"))))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= x["first"] - 1), joined(acc, x)).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def _cut(batches):
    for b in batches:
        out = []
        for text, cut in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            if text and cut:
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                begin, end = words.spans(data, np.array([0, len(data)]))
                kept, done = [], 0
                for s in cut:
                    kept.append(raw[done : begin[s["first"]]])
                    done = int(end[s["last"]])
                text = b"".join([*kept, raw[done:]]).decode()
            out.append(text)
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string())).drop_columns(["spans"])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id", width: int = WINDOW) -> DataFrame:
    """docs with the spans cut out of text, from the first letter of a span to its last; what stands around stays. Other columns,
    whatever their names, and rows without spans stay as they are."""
    cols = docs.columns
    docs, (text, key) = plain_names(docs, text, key)
    found = materialize(find(docs, benchmark, text, key, item_text, item, width).filter(F.size("spans") > 0).dropDuplicates(["id", "print"]), "spans")
    found = found.select(F.col("id").alias("__id"), F.col("print").alias("__print"), "spans")
    both = docs.join(found, F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__print")), "left")
    both = both.select(*(F.col(c).alias("text") if c == text else F.col(c) for c in docs.columns), "spans")
    return both.mapInArrow(_cut, both.drop("spans").schema).toDF(*cols)


def digest(names) -> F.Column:
    return F.sha2(F.concat_ws(",", names), 256)


def op11(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest(F.col("items")).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same in DuckDB's SQL: windows of documents as text, joined to those of items.
SQL = rf"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[p : p + least(len(w), {WINDOW}) - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
s AS (SELECT DISTINCT size FROM i),
o AS (SELECT r, p, size, array_to_string(w[p : p + size - 1], ' ') AS phrase FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, s WHERE len(w) >= size)),
f AS (SELECT r, p, o.size, item FROM o JOIN i ON o.size = i.size AND o.phrase = i.phrase),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT r, p, size FROM f)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
