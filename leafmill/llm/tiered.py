"""Ranked lexical search (operator 13) over an index in tiers: high-impact postings first, with a bound per term on all that is left.

Documents are read once: a shard of some megabytes becomes one row with its postings of the items' terms. Counted levels of
impact give each term its cuts, and the index is written with a column of postings for each tier, so a pass over a tier reads
those columns alone. A pass sums what it knows of each document and adds the terms' residual bounds for what it doesn't. An item
is proved exact where no document beyond a bounded set can reach the fiftieth known sum; that set's scores are then completed
from the lower tiers. Items without such a proof fall through to the next tier; in the last nothing is left to bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import materialize, table, utf8

TOP = 50
#: Tiers, and of the first ones the least length of a term's list and the share of all its postings (one in so many).
TIERS = 3
FIRST = ((1 << 10, 64), (1 << 14, 8))
#: Levels that impacts are counted by, each this wide; a term's impact in a document is below 1,000,000.
LEVELS, WIDE = 64, 15_625
#: Documents at most that an item may leave to be completed; with more it falls through.
COMPLETE = 1 << 10
#: Items and words of a block, which is sent to all executors; more items take more passes.
ITEMS, WORDS = 1 << 10, 1 << 17
_SLICE = 4 << 20
_EXPAND = 1 << 21

_SHARD = "shard long, ids binary, nulls binary, n binary, n_docs long, n_terms long, "
FORWARD = _SHARD + "postings binary"
INDEX = _SHARD + ", ".join(f"tier{t} binary" for t in range(TIERS))
HITS = "item int, score long, doc_id long, shard long, doc int"


class Items:
    """A block of items: pairs of item and term, and the terms' numbers."""

    def __init__(self, texts: list[str | None]):
        column = pa.array(texts, pa.string())
        h, at = words.of_rows(*utf8(column))
        self.n = len(texts)
        self.vocabulary = words.Vocabulary(h)
        term = self.vocabulary.number(h).astype(np.int64)
        pairs = np.unique(np.repeat(np.arange(self.n), np.diff(at)) * (len(self.vocabulary) + 1) + term)
        self.item, self.term = pairs // (len(self.vocabulary) + 1), pairs % (len(self.vocabulary) + 1)


def _forward(sent):
    def run(batches):
        vocabulary, task, number = sent.value.vocabulary, TaskContext.get().partitionId(), 0
        for b in batches:
            ids, text = b.column("id"), b.column("text")
            data, offsets = utf8(text)
            rows = []
            for a, z in words.slices(offsets, _SLICE):
                h, at = words.of_rows(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                n, s, docs = np.diff(at), vocabulary.number(h), z - a
                row = np.repeat(np.arange(docs), n)[s > 0]
                key, tf = np.unique(s[s > 0].astype(np.int64) * docs + row, return_counts=True)
                postings = np.concatenate([key // docs, key % docs, tf]).astype("<i4").tobytes()
                some = ids.slice(a, docs)
                raw = np.asarray(some.fill_null(0)).astype("<i8").tobytes()
                rows.append((task << 32 | number, raw, np.asarray(some.is_null()).tobytes(), n.astype("<i8").tobytes(), int((n > 0).sum()), int(n.sum()), postings))
                number += 1
            yield _batch(rows, FORWARD)

    return run


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])


def _thirds(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(3, -1).astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term's tf occurrences in a document of n terms are worth, before the term's weight."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        m = np.array([50 + 50 * x * docs // terms for x in n.tolist()], np.int64)
    else:
        m = 50 + 50 * n * docs // max(terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _of_shard(r: dict, docs: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    term, doc, tf = _thirds(r["postings"])
    return term, doc, impacts(tf, np.frombuffer(r["n"], "<i8")[doc], docs, terms)


def _counted(docs: int, terms: int):
    def run(batches):
        total: dict[int, int] = {}
        for b in batches:
            for r in b.to_pylist():
                term, _, f = _of_shard(r, docs, terms)
                for k, c in zip(*(x.tolist() for x in np.unique(term * LEVELS + f // WIDE, return_counts=True))):
                    total[k] = total.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    return run


class Cuts:
    """By term: the weight, the level where each tier begins, and the bound on the impact of what lies in lower tiers."""

    def __init__(self, size: int, docs: int, keys: np.ndarray, counts: np.ndarray):
        by = np.zeros((size + 1, LEVELS), np.int64)
        by[keys // LEVELS, keys % LEVELS] = counts
        df = by.sum(1)
        self.weight = np.array([weight(docs, x) for x in df.tolist()], np.int64)
        above = by[:, ::-1].cumsum(1)[:, ::-1]  # postings at a level or higher
        self.level, self.rest = [], []
        for least, share in FIRST[: TIERS - 1]:
            fits = above <= np.maximum(least, df // share)[:, None]
            cut = np.where(fits.any(1), fits.argmax(1), LEVELS)
            below = np.where(np.arange(LEVELS) < cut[:, None], by, 0) > 0
            top = np.where(below.any(1), LEVELS - 1 - below[:, ::-1].argmax(1), -1)
            self.level.append(cut)
            self.rest.append(self.weight * np.maximum((top + 1) * WIDE - 1, 0) * (top >= 0))
        self.level.append(np.zeros(size + 1, np.int64))
        self.rest.append(np.zeros(size + 1, np.int64))


def _tiers(sent, docs: int, terms: int):
    def run(batches):
        cuts = sent.value
        for b in batches:
            rows = []
            for r in b.to_pylist():
                term, doc, f = _of_shard(r, docs, terms)
                tier = sum((f // WIDE < cuts.level[t][term]).astype(np.int64) for t in range(TIERS - 1)) + np.zeros(len(term), np.int64)
                parts = [np.concatenate([x[tier == t] for x in (term, doc, f)]).astype("<i4").tobytes() for t in range(TIERS)]
                rows.append((r["shard"], r["ids"], r["nulls"], r["n"], r["n_docs"], r["n_terms"], *parts))
            yield _batch(rows, INDEX)

    return run


class _Sums:
    """Known sums and bounds of a shard's documents for the open items."""

    def __init__(self, items: Items, cuts: Cuts, open_: np.ndarray, tier: int):
        slot = np.full(items.n, -1)
        slot[open_] = np.arange(len(open_))
        use = slot[items.item] >= 0
        self.item, self.term, self.tier, self.cuts, self.n = slot[items.item[use]], items.term[use], tier, cuts, len(open_)
        self.rest = cuts.rest[tier]
        self.bound = np.bincount(self.item, self.rest[self.term], self.n).astype(np.float64)
        #: Sums below 2**53 are exact in doubles.
        self.exact = float(np.bincount(self.item, cuts.weight[self.term], self.n).max(initial=0)) * 1e6 < 2**53

    def of(self, r: dict, docs: int, all_tiers: bool = False) -> tuple[np.ndarray, np.ndarray]:
        kind = np.float64 if self.exact else np.int64
        known, seen = np.zeros(self.n * docs, kind), np.zeros(self.n * docs, kind)
        for t in range(TIERS if all_tiers else self.tier + 1):
            term, doc, f = _thirds(r[f"tier{t}"])
            lo, hi = np.searchsorted(term, self.term), np.searchsorted(term, self.term, "right")
            upto = np.cumsum(hi - lo)
            a = 0
            while a < len(upto):  # some pairs of item and term at a time
                z = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _EXPAND, "right")), a + 1)
                n = (hi - lo)[a:z]
                if n.any():
                    i = np.repeat(lo[a:z] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    place = np.repeat(self.item[a:z] * docs, n) + doc[i]
                    of = np.repeat(self.term[a:z], n)
                    for total, worth in ((known, self.cuts.weight[of] * f[i]), (seen, self.rest[of])) if self.tier < TIERS - 1 and not all_tiers else ((known, self.cuts.weight[of] * f[i]),):
                        if self.exact:
                            total += np.bincount(place, worth, len(total))
                        else:
                            np.add.at(total, place, worth)
                a = z
        known = known.reshape(self.n, docs)
        return known, known + self.bound[:, None] - seen.reshape(self.n, docs)


def best(item, score, ids, nulls, most: int) -> np.ndarray:
    """Which entries are the first `most` of their item: by score, then by id, null ones last."""
    by = np.lexsort((ids, nulls, -score, item))
    of = item[by]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    place = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
    return by[place < most]


def _found(sums: _Sums, open_: np.ndarray, held: list[np.ndarray]) -> pa.RecordBatch:
    item, score, ids, nulls, shard, doc = held
    arrays = [pa.array(open_[item], pa.int32()), pa.array(score.astype(np.int64)), pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(shard, pa.int64()), pa.array(doc, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in HITS.split(", ")])


def _entries(r: dict, docs: int, which: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
    i, d = np.nonzero(which)
    return [i, score[i, d], np.frombuffer(r["ids"], "<i8")[d], np.frombuffer(r["nulls"], "u1")[d], np.full(len(i), r["shard"]), d]


def _leading(sent, open_: np.ndarray, tier: int, most: int):
    """The first documents of each item by what is known of them, of all shards of a task."""

    def run(batches):
        items, cuts = sent.value
        sums = _Sums(items, cuts, open_, tier)
        least = np.ones(sums.n)
        held = None
        for b in batches:
            for r in b.to_pylist():
                docs = len(r["nulls"])
                known, _ = sums.of(r, docs)
                new = _entries(r, docs, known >= least[:, None], known)
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                stay = best(*held[:4], most)
                held = [x[stay] for x in held]
                count = np.bincount(held[0], minlength=sums.n)
                full = np.flatnonzero(count >= most)
                least[full] = held[1][np.cumsum(count)[full] - 1]
        if held is not None:
            yield _found(sums, open_, held)

    return run


def _reaching(sent, open_: np.ndarray, tier: int, least: np.ndarray):
    """All documents of a task that can reach an item's least score; of an item with too many, COMPLETE + 1."""

    def run(batches):
        items, cuts = sent.value
        sums = _Sums(items, cuts, open_, tier)
        count = np.zeros(sums.n, np.int64)
        for b in batches:
            for r in b.to_pylist():
                docs = len(r["nulls"])
                known, bound = sums.of(r, docs)
                entries = _entries(r, docs, (bound >= least[:, None]) & (count <= COMPLETE)[:, None], known)
                place = np.arange(len(entries[0])) - np.searchsorted(entries[0], entries[0])
                entries = [x[count[entries[0]] + place <= COMPLETE] for x in entries]
                count += np.bincount(entries[0], minlength=sums.n)
                yield _found(sums, open_, entries)

    return run


def _completed(sent, open_: np.ndarray):
    """The whole scores of the candidates of each shard, from all its tiers."""

    def run(batches):
        items, cuts = sent.value
        sums = _Sums(items, cuts, open_, TIERS - 1)
        slot = np.full(items.n, -1)
        slot[open_] = np.arange(len(open_))
        for b in batches:
            for r in b.to_pylist():
                docs = len(r["nulls"])
                known, _ = sums.of(r, docs, all_tiers=True)
                which = np.zeros(known.shape, bool)
                which[slot[[x["item"] for x in r["wanted"]]], [x["doc"] for x in r["wanted"]]] = True
                yield _found(sums, open_, _entries(r, docs, which & (known > 0), known))

    return run


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _block(docs: DataFrame, rows: list, most: int) -> DataFrame:
    """item_id, rank, doc_id, score and tier for a block of items."""
    spark = docs.sparkSession
    items = Items([r.text for r in rows])
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {rows[0].kind}")
    sent = spark.sparkContext.broadcast(items)
    forward = materialize(docs.mapInArrow(_forward(sent), FORWARD), "forward")
    n, terms = (x or 0 for x in forward.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    counts = forward.select("n", "postings").mapInArrow(_counted(n, terms), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    cuts = Cuts(len(items.vocabulary), n, *(np.asarray(counts.column(c)) for c in ("key", "n")))
    index = materialize(forward.mapInArrow(_tiers(spark.sparkContext.broadcast(cuts), n, terms), INDEX), "tiers")
    both = spark.sparkContext.broadcast((items, cuts))
    open_, done = np.unique(items.item), []
    for tier in range(TIERS):
        if not len(open_):
            break
        read = index.select("shard", "ids", "nulls", *(f"tier{t}" for t in range(tier + 1)))
        leading = _ranked(read.mapInArrow(_leading(both, open_, tier, most), HITS), most).drop("shard", "doc")
        if tier == TIERS - 1:
            done.append(leading.withColumn("tier", F.lit(tier)))
            break
        last = {r.item: r.least for r in leading.filter(F.col("rank") == most).select("item", F.col("score").alias("least")).collect()}
        bound = np.bincount(items.item, cuts.rest[tier][items.term], items.n)
        # with fewer than `most` documents known, an item is proved where its terms' lists lie whole in the tiers read
        proved = np.array([i for i in open_.tolist() if bound[i] < last.get(i, 1)], np.int64)
        if len(proved):
            reach = materialize(read.mapInArrow(_reaching(both, proved, tier, np.array([last.get(i, 1) for i in proved.tolist()], float)), HITS), "reaching")
            few = [r.item for r in reach.groupBy("item").count().filter(F.col("count") <= COMPLETE).collect()]
            proved = np.array(sorted(few), np.int64)
        if len(proved):
            wanted = reach.join(F.broadcast(spark.createDataFrame([(int(i),) for i in proved], "item int")), "item")
            wanted = wanted.groupBy("shard").agg(F.collect_list(F.struct("item", "doc")).alias("wanted"))
            whole = index.join(F.broadcast(wanted), "shard")  # at most COMPLETE for each item of the block
            whole = whole.select("shard", "ids", "nulls", "wanted", *(f"tier{t}" for t in range(TIERS)))
            done.append(_ranked(whole.mapInArrow(_completed(both, proved), HITS), most).drop("shard", "doc").withColumn("tier", F.lit(tier)))
            open_ = np.setdiff1d(open_, proved)
    if not done:
        done = [spark.createDataFrame([], HITS.replace(", shard long, doc int", "") + ", rank int, tier int")]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score", "tier")


def search(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id", most: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score and the tier that proved the item, for the first `most` documents of each row of items. Null
    and empty texts have no terms: as documents they count for nothing, as items they return nothing. Repeated rows are
    documents, and items, of their own; equal scores go by id, a null id last."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    size = F.coalesce(F.length("text"), F.lit(0))
    count, letters = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(1, -(-count // ITEMS), -(-letters // (WORDS * 4)))
    asked = asked.withColumn("kind", F.lit(kind)).withColumn("__block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    out = None
    for i in range(n):
        rows = asked.filter(F.col("__block") == i).collect()
        if rows:
            some = _block(docs, rows, most)
            out = some if out is None else out.unionByName(some)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long, tier int")


def op13(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tier")


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same in DuckDB's SQL, every document scored for every item.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY t),
i AS (SELECT DISTINCT b, item_id, unnest({_TERMS.format("text")}) AS t FROM (SELECT row_number() OVER () AS b, * FROM benchmark)),
s AS (SELECT b, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN p USING (t) JOIN f USING (t), c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
