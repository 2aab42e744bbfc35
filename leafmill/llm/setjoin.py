"""Exact set-similarity join of documents on word shingles, by set-relation skipping.

Sets are the distinct shingles of a document, in one global order: rare ones first, by a count sketch over all documents.
Two sets with 100 * intersection >= T * union share a shingle among the first |x| - ceil(T |x| / 100) + 1 of each (their
prefixes), so lists of the sets that have a shingle in their prefix hold every answer.

Relations between sets save work in two ways. Within a list, sorted by set size and cut into blocks, whole blocks of
positions are skipped whose sets cannot overlap enough with the probing set any more (index level). And a set that is found
highly similar to a leader takes over the leader's answers: both are in one class, and only pairs of sets of different
classes are looked at afterwards (answer level). Leaders are the sets nearest to the middle of a list. Then come the likeliest pairs
of each two classes, and with the classes that gives, all pairs of different classes whose parities don't rule
them out. Exact copies are one set from the start. All pairs that remain are verified on the whole sets, so that no link between classes is
lost, and components follow.

What is sent grows with the documents, not with the pairs: postings without any possible partner in their list are dropped once lists are
first read; a set is verified against its nearest leader alone at first, and two classes by their likeliest pair alone; and pairs of long
sets, which the lists' parities cannot tell apart, are judged by wider ones before a whole set is sent.

Lists are counted, and those longer than SPLIT are dealt over several keys: leaders are sought in each part; likeliest pairs among one
set of each class; and at last the largest class lies in parts, each with all sets of the other classes (or part against part, where those are too
many as well). So no list is a task of its own.

Nulls and odd input: a null or wordless text has an empty set and links with nothing; one with fewer words than a shingle
has its whole sequence of words as one shingle; a row without an id is reported with a null component. Rows with one id are
one document, linked by the set of any of its rows. Long texts are never cut. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import INVERSE, byte_table, materialize, mix64, modest_batches, powers, prefix_sums, table, utf8
from .graph import components

#: Counters of the sketch that orders shingles: its size does not depend on the data, nor does any result depend on it.
COUNTERS = 1 << 20
SLICES = 64
#: Postings of a list that go to one key, about.
SPLIT = 50_000
#: Lists up to this length are compared as a whole, many at once; the leaders that are taken from a longer one.
SHORT, LEADERS = 32, 8
#: Positions of a list that are tested, and skipped, together.
BLOCK = 64
#: 64-bit words of the parities that tell before verification that two sets differ too much.
PARITY = 8
PARITIES = [f"p{i}" for i in range(PARITY)]
#: Lists up to this length are searched for postings that have no possible partner.
MIDDLE = 1_024
#: Sets of more shingles than this are judged by WIDE bits of parities before they are sent whole.
LONG, WIDE = 512, 1 << 13
#: Members that one task verifies against a leader.
FANOUT = 2_000
#: Parts that rows of equal sets are dealt over.
SALTS = 64
_FOLDED = byte_table(0xC0FFEE, fold_case=True)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of the distinct n-word shingles of each text (sorted), and where each text's begin."""
    out: list[np.ndarray] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    i = 0
    while i < len(counts):
        j = int(np.searchsorted(offsets, offsets[i] + 500_000, side="right")) - 1
        j = min(max(j, i + 1), len(counts))
        part, k = _shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
        out.append(part)
        counts[i:j] = k
        i = j
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.append(0, np.cumsum(counts))


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    word = ~_SPACE[data]
    inner = offsets[1:-1][(offsets[1:-1] < len(data)) & (offsets[1:-1] > 0)]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    sums = prefix_sums(data, _FOLDED)
    w = mix64((sums[stop] - sums[start]) * powers(INVERSE, len(data))[start] + (stop - start).astype(np.uint64))
    owner = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(owner, minlength=docs)
    first = np.cumsum(words) - words
    h = np.zeros(len(w), np.uint64)
    for k in range(n):  # sums beyond a text's end belong to no shingle
        h[: len(w) - k] += mix64(w[k:] + np.uint64((k + 1) * 0xA24BAED4963EE407 % 2**64))
    place = np.arange(len(w)) - first[owner]
    whole = place <= words[owner] - n
    short = (words[owner] < n) & (place == 0)
    for at in np.flatnonzero(short):
        k = int(words[owner[at]])
        h[at] = np.uint64(sum(int(x) for x in mix64(w[at : at + k] + (np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)))) + k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    keep = whole | short
    h, counts = mix64(h[keep]), np.bincount(owner[keep], minlength=docs)
    sets = [_distinct(x) for x in np.split(h, np.cumsum(counts)[:-1])]
    return np.concatenate(sets), np.array([len(x) for x in sets], np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


SETS = "id long, n int, hi long, lo long, " + "".join(f"{p} long, " for p in PARITIES) + "slice int, counts binary"


def parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set whether an odd number of its shingles falls on each of 64 * PARITY bits. Where two sets' bits differ,
    their difference has a shingle: the bits that differ are no more than the shingles that do."""
    docs, bits = len(at) - 1, 64 * PARITY
    bit = (h >> np.uint64(40)).astype(np.int64) % bits
    counts = np.bincount(np.repeat(np.arange(docs), np.diff(at)) * bits + bit, minlength=docs * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(docs, bits), axis=1).view(np.int64)


def _summaries(key: str, text: str, words: int):
    """SETS: a row for each document, and at the end the task's part of the sketch in slices."""

    def run(batches):
        sketch = np.zeros(COUNTERS, np.uint32)
        names = [x.split()[0] for x in SETS.split(", ")]
        for b in batches:
            data, offsets = utf8(b.column(text))
            h, at = shingles(data, offsets, words)
            sketch += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            n = np.diff(at)
            hi, lo = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            full = n > 0
            if full.any():
                heads = at[:-1][full]
                hi[full] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), heads)
                lo[full] = np.add.reduceat(mix64(h + np.uint64(0x14057B7EF767814F)), heads)
            k, odd = len(n), parities(h, at)
            ids = b.column(key).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in odd.T), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if sketch.any():
            parts = [x.tobytes() for x in np.split(sketch, SLICES)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(SLICES, pa.int32()), *[none] * (2 + PARITY), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _summed(batches):
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
            totals[k] = totals.get(k, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], names=["slice", "counts"])


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: COUNTERS numbers, whatever the data."""
    rows = parts.filter("slice is not null").select("slice", "counts").repartition(SLICES // 4, "slice").mapInArrow(_summed, "slice int, counts binary").collect()
    total = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in rows:
        total[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    return total.ravel()


def levels(counts: np.ndarray) -> np.ndarray:
    """The order of magnitude of each counter, which is all that the order of shingles needs."""
    return np.frexp(counts.astype(float))[1].astype(np.uint8)


def ordered(h: np.ndarray, level: np.ndarray, most: int | None = None) -> np.ndarray:
    """The first `most` shingles of a set (ascending numbers) in the global order: by magnitude of their counts, then number."""
    rank = level[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
    return h[np.argsort(rank, kind="stable")[:most]]


POSTINGS = "token long, id long, sp long"


def _postings(key: str, text: str, words: int, percent: int, sent):
    """The prefix of each set: token, document, and size and place as size << 32 | place."""

    def run(batches):
        seen: set[tuple[int, ...]] = set()
        for b in batches:
            data, offsets = utf8(b.column(text))
            h, at = shingles(data, offsets, words)
            tokens, ids, sps = [], [], []
            for k, lo, hi in zip(b.column(key).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if k is None or lo == hi:
                    continue
                own = h[lo:hi]
                mark = (int(own.sum()), int(own[0]), int(own[-1]), hi - lo)
                if mark in seen:  # a copy that this task has listed already; classes of copies come from whole sums
                    continue
                seen.add(mark)
                x = ordered(own, sent.value, prefix(len(own), percent))
                tokens.append(x)
                ids.append(np.full(len(x), k, np.int64))
                sps.append((hi - lo) << 32 | np.arange(len(x)))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sps))], names=["token", "id", "sp"])

    return run


def _lists(batches, columns: tuple[str, ...], longest: int | None = None):
    """Rows of whole lists, from a partition sorted by the first column: (columns, where each list begins, plus the end).

    A list stays in pieces until its end is seen, or comes in pieces of `longest` rows or more."""
    parts: list[list[np.ndarray]] = []
    for b in _and_none(batches):
        if b is not None:
            if not b.num_rows:
                continue
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            open_ = bool(parts) and parts[0][0][0] == new[0][-1]  # no list ends here
            parts.append(new)
            if open_ and (longest is None or sum(len(p[0]) for p in parts) < longest):
                continue
        if not parts:
            return
        rows = [np.concatenate(x) for x in zip(*parts)]
        t = rows[0]
        heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        last = len(t) if b is None or longest and len(t) - heads[-1] >= longest else int(heads[-1])
        if last:
            yield [c[:last] for c in rows], np.append(heads[heads < last], last)
        parts = [[c[last:] for c in rows]] if last < len(t) else []


def _and_none(it):
    yield from it
    yield None


def _pairs_within(heads: np.ndarray, lengths: np.ndarray, room: int = 100_000):
    """All pairs (i, j), i < j, of rows of one list, for lists of SHORT rows at most; so many lists at once that pairs stay within room."""
    for k in np.unique(lengths[lengths > 1]).tolist():
        at = heads[lengths == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, room // len(i))
        for x in range(0, len(at), step):
            base = at[x : x + step, None]
            yield (base + i).ravel(), (base + j).ravel()


def _shared(percent: int):
    """The postings that another one of their list may go with, as far as sizes and places tell; of very long lists, all."""

    def run(batches):
        before = None
        for (token, ids, sp), bounds in _lists(batches, ("token", "id", "sp"), SPLIT):
            lengths = np.diff(bounds)
            size, place = sp >> 32, sp & 0xFFFFFFFF
            keep = np.repeat(lengths > SHORT, lengths)
            if token[0] == before:  # the rest of a very long list
                keep[: bounds[1]] = True
            before = token[-1]
            for i, j in _pairs_within(bounds[:-1], np.where(lengths > SHORT, 0, lengths)):
                ok = fits(size[i], place[i], size[j], place[j], percent) & (ids[i] != ids[j])
                keep[i[ok]] = keep[j[ok]] = True
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(ids[keep]), pa.array(sp[keep])], names=["token", "id", "sp"])

    return run


def fits(size: np.ndarray, place: np.ndarray, other: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that have a shingle at these places can still overlap enough."""
    return np.minimum(size - place, other - at) * (100 + percent) >= percent * (size + other)


class _Lists:
    """Some lists of a task: what stands in their rows, and which rows may go together."""

    def __init__(self, columns: list[np.ndarray], percent: int):
        _, self.ids, sp, *rest = columns
        self.size, self.place, self.percent = sp >> 32, sp & 0xFFFFFFFF, percent
        self.bits = np.stack(rest[-PARITY:], axis=1).view(np.uint64)

    def apart(self, i, j) -> np.ndarray:
        return np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=-1, dtype=np.int64)

    def may(self, i, j, apart: np.ndarray) -> np.ndarray:
        near = apart * (100 + self.percent) <= (100 - self.percent) * (self.size[i] + self.size[j])
        return near & (self.ids[i] != self.ids[j]) & fits(self.size[i], self.place[i], self.size[j], self.place[j], self.percent)


LED = "a long, b long, apart long, n long, list long, id long, sp long, " + ", ".join(f"{p} long" for p in PARITIES)
BETWEEN = "a long, b long, apart long, n long, ca long, cb long"


def _distinct_rows(rows: list[np.ndarray], names: str):
    """A batch of the named columns of whole numbers, each row once."""
    if rows and sum(map(len, rows)):
        found = np.unique(np.concatenate(rows), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], names=names.split())


def _first_of(*keys: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Places of the rows with the smallest `by` for each combination of keys."""
    order = np.lexsort((by, *reversed(keys)))
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order[fresh]


def _led(rows: pa.RecordBatch) -> pa.RecordBatch:
    """rows with all columns of LED, null where they have none."""
    names = [x.split()[0] for x in LED.split(", ")]
    none = pa.nulls(rows.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([rows.column(c) if c in rows.schema.names else none for c in names], names=names)


def _partnered(x: _Lists, lo: int, hi: int, kept: np.ndarray) -> None:
    """Marks in kept the rows lo to hi, one list, that may go with another of it; sizes ascend there."""
    size, at = x.size[lo:hi], np.arange(hi - lo)
    reach = np.maximum(np.searchsorted(size, size * 100 // x.percent, "right") - at - 1, 0)  # of so many behind it, sizes fit
    block = np.cumsum(reach) // 100_000
    for k in np.unique(block).tolist():
        own, many = at[block == k], reach[block == k]
        one = lo + np.repeat(own, many)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
        ok = x.may(one, two, x.apart(one, two))
        kept[one[ok]] = kept[two[ok]] = True


def _leaders(percent: int, postings: bool = False):
    """(leader, set) pairs; if asked, also the postings that may go with another one of their list (of lists longer than MIDDLE, all),
    as rows of LED.

    In a short list a set's leader is the set before it whose parity is nearest. In a long one, LEADERS times, it is the set
    nearest to the middle of those without a leader, and all that may go with it are its members."""
    own = ("list",) if postings else ()

    def run(batches):
        for columns, bounds in _lists(batches, ("token", "id", "sp", *own, *PARITIES)):
            x, found, kept = _Lists(columns, percent), [], np.zeros(len(columns[0]), bool)
            lengths = np.diff(bounds)

            def hold(lead, j, apart):
                found.append(np.stack([x.ids[lead], x.ids[j], apart, np.minimum(x.size[lead], x.size[j])], axis=1))

            for i, j in _pairs_within(bounds[:-1], np.where(lengths > SHORT, 0, lengths)):
                apart = x.apart(i, j)
                ok = x.may(i, j, apart)
                i, j, apart = i[ok], j[ok], apart[ok]
                kept[i] = kept[j] = True
                best = _first_of(j, by=apart)
                hold(i[best], j[best], apart[best])
            for lo, hi in zip(bounds[:-1][lengths > SHORT].tolist(), bounds[1:][lengths > SHORT].tolist()):
                if hi - lo > MIDDLE:
                    kept[lo:hi] = True
                else:
                    _partnered(x, lo, hi, kept)
                left = lo + np.flatnonzero(kept[lo:hi])
                for _ in range(LEADERS):
                    if len(left) < 2:
                        break
                    middle = 2 * sum(np.unpackbits(x.bits[k].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for k in np.array_split(left, 1 + len(left) // 4096)) > len(left)
                    lead = left[np.argmin(np.bitwise_count(x.bits[left] ^ np.packbits(middle).view(np.uint64)).sum(axis=1))]
                    apart = x.apart(left, lead)
                    member = x.may(left, lead, apart)
                    hold(np.full(int(member.sum()), lead), left[member], apart[member])
                    left = left[~member & (left != lead)]
            for rows in _distinct_rows(found, "a b apart n"):
                yield _led(rows) if postings else rows
            if postings and kept.any():
                yield _led(pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns[1:]], names=["id", "sp", "list", *PARITIES]))

    return run


def _between(percent: int, first: bool):
    """Pairs of sets of different classes that share a list and can overlap enough; whole blocks are skipped by position, and
    pairs whose parities differ in more bits than their sets may in shingles. first: of two classes in a list the likeliest pair."""

    def run(batches):
        for columns, bounds in _lists(batches, ("token", "id", "sp", "cls", *PARITIES)):
            x, cls, found = _Lists(columns, percent), columns[3], []
            lengths = np.diff(bounds)

            def hold(i, j, of):
                apart = x.apart(i, j)
                ok = x.may(i, j, apart)
                i, j, apart = i[ok], j[ok], apart[ok]
                if first and len(i):
                    best = _first_of(np.broadcast_to(of, ok.shape)[ok], np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), by=apart)
                    i, j = i[best], j[best]
                low = x.ids[i] < x.ids[j]
                i, j = np.where(low, i, j), np.where(low, j, i)
                found.append(np.stack([x.ids[i], x.ids[j], x.apart(i, j), np.minimum(x.size[i], x.size[j]), np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1))

            for i, j in _pairs_within(bounds[:-1], np.where(lengths > SHORT, 0, lengths)):
                other = cls[i] != cls[j]
                i, j = i[other], j[other]
                hold(i, j, np.searchsorted(bounds, i, side="right"))
            for lo, hi in zip(bounds[:-1][lengths > SHORT].tolist(), bounds[1:][lengths > SHORT].tolist()):
                kinds, k = np.unique(cls[lo:hi], return_counts=True)
                if len(kinds) == 1:
                    continue
                minor = lo + np.flatnonzero(cls[lo:hi] != kinds[np.argmax(k)])  # one of each pair is not in the largest class
                cuts = np.arange(lo, hi, BLOCK)
                ends = np.append(cuts[1:], hi) - 1
                least, most = x.size[cuts], x.size[ends]  # sizes ascend
                left = np.maximum.reduceat((x.size - x.place)[lo:hi], cuts - lo)  # the most that a set of the block has left here
                own = np.where(np.minimum.reduceat(cls[lo:hi], cuts - lo) == np.maximum.reduceat(cls[lo:hi], cuts - lo), cls[cuts], -1)
                one = own >= 0
                open_i, open_j, room = [], [], 0
                for i in minor.tolist():
                    s, p = int(x.size[i]), int(x.place[i])
                    go = (least * percent <= s * 100) & (most * 100 >= s * percent) & (np.minimum(left, s - p) * (100 + percent) >= percent * (least + s)) & ~(one & (own == cls[i]))
                    take = (cuts[go][:, None] + np.arange(BLOCK)).ravel()
                    take = take[take < hi]
                    take = take[cls[take] != cls[i]]
                    open_i.append(np.full(len(take), i))
                    open_j.append(take)
                    room += len(take)
                    if room > 100_000:
                        hold(np.concatenate(open_i), np.concatenate(open_j), lo)
                        open_i, open_j, room = [], [], 0
                if room:
                    hold(np.concatenate(open_i), np.concatenate(open_j), lo)
            yield from _distinct_rows(found, "a b apart n ca cb")

    return run


def in_parts(lists: DataFrame) -> DataFrame:
    """lists with a key for each list, or for each part of one that is longer than SPLIT."""
    long = lists.groupBy("token").count().filter(F.col("count") > SPLIT).select(F.col("token").alias("__t"), F.ceil(F.col("count") / SPLIT).alias("__parts"))
    part = F.when(F.col("__parts").isNull(), F.col("token")).otherwise(F.xxhash64("token", F.pmod(F.xxhash64("id"), F.col("__parts"))))
    dealt = lists.join(long, F.col("token") == F.col("__t"), "left").withColumn("key", part).drop("__t", "__parts")
    return dealt.withColumnsRenamed({"token": "list", "key": "token"})


def across(known: DataFrame, first: bool) -> DataFrame:
    """The postings of lists with several classes, with keys under which all pairs of different classes meet.

    first: of each list that is longer than SPLIT one set of each class. Otherwise such a list's largest class is dealt over
    parts and the others are in every part; if these are too many as well, every two parts meet."""
    counts = known.groupBy("token", "cls").agg(F.count("*").alias("k"))
    lists = counts.groupBy(F.col("token").alias("__t")).agg(F.sum("k").alias("__all"), F.max("k").alias("__most"), F.max_by("cls", F.struct("k", "cls")).alias("__main"), F.min("cls").alias("__lo"), F.max("cls").alias("__hi"))
    open_ = known.join(lists.filter("__lo < __hi"), F.col("token") == F.col("__t"))
    parts, rest = F.ceil(F.col("__all") / SPLIT), F.col("__all") - F.col("__most")
    if first:
        rows = ["id", "sp", *PARITIES]
        short = open_.filter(F.col("__all") <= SPLIT).select("token", "cls", *rows)
        one = open_.filter(F.col("__all") > SPLIT).groupBy("token", "cls").agg(F.max_by(F.struct(*rows), F.struct("leads", "id")).alias("r")).select("token", "cls", "r.*")
        return in_parts(short.unionByName(one))
    mine = F.pmod(F.xxhash64("id"), parts)
    all_parts = F.sequence(F.lit(0).cast("long"), parts - 1)
    pair = F.transform(all_parts, lambda z: F.xxhash64("token", F.least(mine, z), F.greatest(mine, z)))
    one = F.xxhash64("token", mine)
    keys = F.when(parts <= 1, F.array("token")).when(rest > SPLIT, pair).when(F.col("cls") == F.col("__main"), F.array(one)).otherwise(F.transform(all_parts, lambda z: F.xxhash64("token", z)))
    return open_.withColumn("key", F.explode(keys)).select(F.col("key").alias("token"), "id", "sp", "cls", *PARITIES)


def rows_of(docs: DataFrame, ids: DataFrame, seen: int = 28) -> DataFrame:
    """The rows of docs whose id is in ids, and seldom others: a bit array that every id of `ids` is in is sent to all tasks, eight bits or
    more for each id, 2**seen bits (32 MB) at most. Texts are not moved, and don't leave the JVM."""
    spark = docs.sparkSession
    bits = 1 << min(seen, max(16, (8 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("v"))
    got = rows.toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[got.column("w").to_numpy()] = got.column("v").to_numpy()
    array = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
    sent = spark.createDataFrame(pa.table({"__words": array}))
    word = F.get("__words", F.shiftright(slot, 6).cast("int"))
    return docs.join(F.broadcast(sent), F.expr("id IS NOT NULL") & (F.call_function("getbit", word, slot.bitwiseAND(63).cast("int")) == 1)).select(docs.columns)


def _wide(h: np.ndarray) -> bytes:
    """How many shingles a set has, and whether an odd number of them falls on each of WIDE bits."""
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % WIDE, minlength=WIDE) & 1
    return np.append(np.uint64(len(h)), np.packbits(odd.astype(np.uint8)).view(np.uint64)).tobytes()


def _members(words: int, told: Callable[[np.ndarray], bytes]):
    """For each wanted document its set, as it is told, once for each (leader, salt, kind)."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            h, at = shingles(data, offsets, words)
            keys = b.column("id").to_pylist()
            rows: list[tuple] = []
            held = 0
            for i, wanted in enumerate(b.column("wanted").to_pylist()):
                raw = told(h[at[i] : at[i + 1]])
                for w in wanted:
                    rows.append((w["a"], w["salt"], w["kind"], keys[i], raw))
                    held += len(raw)
                    if held > 8_000_000:
                        yield _member_batch(rows)
                        rows, held = [], 0
            if rows:
                yield _member_batch(rows)

    return run


MEMBERS = "a long, salt int, kind int, b long, members binary"


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in MEMBERS.split(", ")])


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two ascending arrays of distinct numbers share."""
    if not len(x) or not len(y):
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def _linked(percent: int):
    """0 for two sets that are similar enough, or None."""

    def test(x: np.ndarray, y: np.ndarray) -> int | None:
        both = common(x, y)
        return 0 if 100 * both >= percent * (len(x) + len(y) - both) else None

    return test


def _near(percent: int):
    """In how many of WIDE bits two sets differ, or None if these are more than their shingles may."""

    def test(x: np.ndarray, y: np.ndarray) -> int | None:
        apart = int(np.bitwise_count(x[1:] ^ y[1:]).sum())
        return apart if apart * (100 + percent) <= (100 - percent) * int(x[0] + y[0]) else None

    return test


def _tested(test: Callable[[np.ndarray, np.ndarray], int | None]):
    """What the test says of rows sorted by leader and salt, the leader's own sets (of each of its rows) first; without None."""

    def run(batches):
        now, leads = None, []
        for b in batches:
            got = []
            for a, salt, kind, other, raw in zip(*(b.column(c).to_pylist() for c in ("a", "salt", "kind", "b", "members"))):
                x = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    leads = [*leads, x] if (a, salt) == now else [x]
                    now = (a, salt)
                    continue
                if (a, salt) != now:
                    raise ValueError(f"the set of {a} is missing")
                for lead in leads:
                    said = test(x, lead)
                    if said is not None:
                        got.append((a, other, said))
                        break
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["a", "b", "apart"])

    return run


def _met(docs: DataFrame, pairs: DataFrame, words: int, told: Callable[[np.ndarray], bytes], test: Callable[[np.ndarray, np.ndarray], int | None], name: str) -> DataFrame:
    """a, b, apart: what the test says of the pairs (a, b). docs: id and text. A document's set is made once and sent
    once for each pair that it is in; the sets of leaders of many pairs are sent once for each FANOUT of them."""
    spark = docs.sparkSession
    many = pairs.groupBy(F.col("a").alias("lead")).agg(F.ceil(F.count("*") / FANOUT).cast("int").alias("salts"))
    salted = pairs.join(many, F.col("a") == F.col("lead")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    heads = many.select(F.col("lead").alias("a"), F.col("lead").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    wanted = salted.select("a", F.col("b").alias("id"), "salt", F.lit(1).alias("kind")).unionByName(heads.select("a", "id", "salt", "kind"))
    wanted = materialize(wanted.groupBy("id").agg(F.collect_list(F.struct("a", "salt", "kind")).alias("wanted")), "wanted")
    sets = rows_of(docs.select("id", "text"), wanted.select("id")).join(wanted, "id").mapInArrow(_members(words, told), T.StructType.fromDDL(MEMBERS))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "kind")
    return materialize(dealt.mapInArrow(_tested(test), T.StructType.fromDDL("a long, b long, apart long")), name)


def verify(docs: DataFrame, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough, by the whole sets. docs: id and text."""
    return _met(docs, pairs.select("a", "b"), words, lambda h: h.tobytes(), _linked(percent), "links").select("a", "b")


def narrowed(docs: DataFrame, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b, apart, n and more; n: shingles of the smaller set) without those of long sets whose WIDE parities
    rule them out, a kilobyte for a set; apart is by these where sets are long."""
    long = pairs.filter(F.col("n") > LONG)
    if long.isEmpty():
        return pairs
    near = _met(docs, long.select("a", "b"), words, _wide, _near(percent), "near").groupBy("a", "b").agg(F.min("apart").alias("apart"))
    return pairs.filter(F.col("n") <= LONG).unionByName(long.drop("apart").join(near, ["a", "b"]).select(pairs.columns))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles and component_id, the smallest key that links reach, for each row."""
    spark = modest_batches(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    summary = materialize(docs.mapInArrow(_summaries("id", "text", words), T.StructType.fromDDL(SETS)), "sets")
    sent = spark.sparkContext.broadcast(levels(_sketch(summary)))
    sets = summary.filter("slice is null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    # equal sets: the smallest id of each part first, so that no join has a group's rows in one task
    least = sets.filter("n > 0 and id is not null").groupBy("hi", "lo", "n", "salt").agg(F.min("id").alias("rep"), F.count("*").alias("k"))
    whole = least.groupBy("hi", "lo", "n").agg(F.min("rep").alias("rep"), F.sum("k").alias("k")).filter("k > 1").drop("k")
    copies = least.select("hi", "lo", "n", "salt").join(whole, ["hi", "lo", "n"])
    rows = sets.join(copies, ["hi", "lo", "n", "salt"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"), *PARITIES)
    rows = materialize(rows, "rows")
    # the rows of one id are one document, though their sets may differ
    several = rows.filter("id is not null and n > 0").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").drop("z")
    moved = rows.filter("id <> rep").select("id", "n", "rep").unionByName(rows.join(several, "id", "left_semi").select("id", "n", "rep")).distinct()
    moved = moved.select(F.col("id").alias("__id"), F.col("n").alias("__n"), "rep")
    same = materialize(rows.join(several, "id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "same")

    listed = docs.mapInArrow(_postings("id", "text", words, percent, sent), T.StructType.fromDDL(POSTINGS))
    shared = listed.repartition(n, "token").sortWithinPartitions("token", "sp").mapInArrow(_shared(percent), T.StructType.fromDDL(POSTINGS))
    shared = materialize(shared, "shared")
    # a document's rows may have several sets: a posting goes with the parity of each, and the nearest may count
    marks = rows.filter("id = rep and n > 0").select("id", F.col("n").alias("__n"), *PARITIES).distinct()
    lists = shared.join(moved, (F.col("id") == F.col("__id")) & (F.shiftright("sp", 32) == F.col("__n")), "left").select("token", F.coalesce("rep", "id").alias("id"), "sp").distinct()
    lists = materialize(lists.join(marks, "id").filter(F.shiftright("sp", 32) == F.col("__n")).drop("__n"), "lists")

    def ranked(df: DataFrame) -> DataFrame:
        return df.repartition(n, "token").sortWithinPartitions("token", "sp", "id")

    def once(x: DataFrame, *more: str) -> DataFrame:
        return x.groupBy("a", "b", *more).agg(F.min("apart").alias("apart"), F.min("n").alias("n"))

    def low(x: DataFrame) -> DataFrame:
        return x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    led = materialize(ranked(in_parts(lists)).mapInArrow(_leaders(percent, True), T.StructType.fromDDL(LED)), "led")
    # of the postings only those that have a possible partner: no pair of a later pass has any other
    lists = led.filter("list is not null").select(F.col("list").alias("token"), "id", "sp", *PARITIES)
    seen = materialize(once(led.filter("a is not null")), "leaders")
    near = materialize(narrowed(docs, seen, percent, words), "near")
    # each set with its nearest leader alone: the pairs that are left come later, if their classes still differ
    best = materialize(near.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"), "best")
    links = same.union(verify(docs, best, percent, words))
    classes = components(links)
    leads = seen.select(F.col("a").alias("id")).distinct().withColumn("leads", F.lit(1))
    tried = low(seen.join(near, ["a", "b"], "left_anti").select("a", "b").union(best))
    for first in (True, False):  # the likeliest pair of each two classes, then all that are left
        known = lists.join(classes, F.col("id") == F.col("node"), "left").select("token", "id", "sp", *PARITIES, F.coalesce("component", "id").alias("cls"))
        if first:
            known = known.join(leads, "id", "left").fillna(0, ["leads"])
        found = once(ranked(across(known, first)).mapInArrow(_between(percent, first), T.StructType.fromDDL(BETWEEN)), "ca", "cb")
        again = materialize(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        if again.isEmpty():  # if in the first pass, the second may still have pairs
            continue
        near = materialize(narrowed(docs, again, percent, words), "near")
        chosen = near.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("r")).select("r.*") if first else near.select("a", "b")
        chosen = materialize(chosen, "chosen")
        tried = tried.union(again.join(near, ["a", "b"], "left_anti").select("a", "b")).union(chosen)
        if chosen.isEmpty():
            continue
        more = verify(docs, chosen, percent, words)
        if not more.isEmpty():
            links = links.union(more)
            classes = components(links)
    out = rows.join(classes, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component: of the rows of its smallest key, the one that comes first by text (null first),
    then by the other columns in their order. Rows without a key stay. Columns may have any names."""
    found = join(docs, text, key, words, percent)
    marked = found.filter(F.col("component_id") == F.col(key)).select(F.col(key).alias("__key"), F.lit(True).alias("__stays")).distinct()
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    k, t = (f"c{cols.index(x)}" for x in (key, text))
    kept = plain.join(marked, F.col(k) == F.col("__key"), "left").filter(F.col("__stays") | F.col(k).isNull()).drop("__key", "__stays")
    others = [F.col(c) for c in plain.columns if c not in (k, t)]
    rank = F.row_number().over(Window.partitionBy(k).orderBy(F.col(t), *others))
    return kept.withColumn("rank", F.when(F.col(k).isNull(), 1).otherwise(rank)).filter("rank = 1").drop("rank").toDF(*cols)


def op9(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: The same in DuckDB's SQL: all shingles against all, and reachability by rounds.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 4 THEN list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 85 * (x.k + y.k - p.k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT r.node AS doc_id, coalesce(any_value(n.k), 0)::BIGINT AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""
