"""Token-id files with a minimal perfect hash index.

Documents are encoded in ascending order of their ids and written as shards: a shard's payload is the ids of its documents,
one after another, as little-endian unsigned 32-bit integers and nothing else. Beside it stands the index of the shard's
keys: levels of bit arrays give each key a slot of its own among 0..n-1, and arrays by slot hold a fingerprint of the key,
its place in the payload and its number of ids. A lookup hashes the key, takes a level or two to its slot, compares
fingerprints and slices the payload. A shard is a row of a Parquet table in the shared folder, so that writing it is
committed by Spark and survives lost executors, and holds SHARD_IDS ids at most (or one document).

A key is a document id with its number among rows of the same id, so repeated rows are all kept and found.

Nulls and odd input: a null text is empty and has the end id alone; a null id is a key of its own, after all others; no
rows give no shards. Rows with equal ids follow one another by text. Long texts are never cut. Other columns
are not read and may have any names.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import byte_table, materialize, mix64, table, utf8

END = 0
SHARD_IDS = 2_000_000
#: Bits of a level for each key that is left.
GAMMA = 2.0
LEVELS = 40
#: Bytes of bits to one stored count of ones.
RANKED = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Bytes after which a space surely begins a new piece: ASCII but white space and controls, and parts of other characters.
_BEFORE = np.zeros(256, bool)
_BEFORE[0x21:] = True
#: The last bytes of white space beyond ASCII, by the bytes before them.
_WIDE = {(None, 0xC2): (0x85, 0xA0), (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}
_LAST_OF_WIDE = np.zeros(256, bool)
_LAST_OF_WIDE[[x for v in _WIDE.values() for x in v]] = True
_PRINTS = byte_table(0x0B9E)
_LOW = [chr(i) for i in range(0x250)]
_LETTER = "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == "L")
_DIGIT = "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == "N")
_SPACES = " \\t\\n\\r\\x0b\\x0c"
#: What the tokenizer's own pattern finds in a text of characters below 0x250, none of them ODD.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACES}{_LETTER}{_DIGIT}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0]|[^\x00-\u024f]")


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin in the bytes of rows: at each row that isn't empty, and at each space after a character that isn't
    white space. Not to cut at a space is always right, too."""
    cut = data == 32
    cut[1:] &= _BEFORE[data[:-1]]
    cut[:1] = False
    doubtful = np.flatnonzero(cut[1:] & _LAST_OF_WIDE[data[:-1]]) + 1
    if len(doubtful):
        last, second, third = (np.where(doubtful >= k, data[np.maximum(doubtful - k, 0)], 0) for k in (1, 2, 3))
        for (first, middle), ends in _WIDE.items():
            space = (second == middle) & np.isin(last, ends)
            cut[doubtful[space if first is None else space & (third == first)]] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids as encode(text, add_special_tokens=False) of a byte-level tokenizer gives them, with those of stretches kept.

    A space after a character that isn't white space always begins a new piece, and what follows can't reach before it; so a
    text's ids are those of its stretches from one such space to the next. The distinct stretches of some megabytes are looked
    up, and put in all their places at once; a new one's ids are those of its pieces, which the library's model merges. A tokenizer
    of another kind encodes whole texts, and any encodes as a whole a text that holds an added token."""

    #: Stretches kept in each of two generations, at most, and the longest that are kept; bytes of text at a time.
    KEPT, SHORT, SLICE = 400_000, 48, 4 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]  # the library looks for these in a text first
        byte = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = dict(zip([*byte, *(b for b in range(256) if b not in set(byte))], [*byte, *range(256, 512)]))
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.model = self.whole.model.tokenize
        self.number = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        spec = json.loads(self.whole.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, piece: bytes) -> bytes:
        number = self.number
        return b"".join([number[t.id] for t in self.model(piece.decode("latin-1").translate(self.shown))])

    def _known(self, raw: bytes) -> bytes | None:
        got = self.kept.get(raw)
        if got is None:
            got = self.older.get(raw)
            if got is not None:
                self._keep(raw, got)
        return got

    def _keep(self, raw: bytes, ids: bytes) -> bytes:
        if len(raw) <= self.SHORT:
            if len(self.kept) >= self.KEPT:
                self.older, self.kept = self.kept, {}
            self.kept[raw] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        got = self._known(raw)
        return self._keep(raw, self._merged(raw)) if got is None else got

    def _stretch(self, raw: bytes) -> bytes:
        text = raw.decode()
        if text[:1] == " " and text[1:].isalpha() and max(text) < "\u0250":
            return self._merged(raw)
        if _ODD.search(text):
            return self._library(text)
        return b"".join([self._piece(p) for p in _PIECES.findall(text)])

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        begin = stretches(data, offsets)
        end = np.append(begin[1:], len(data))
        _, at, which = np.unique(words.hashed(data, begin, end, _PRINTS), return_index=True, return_inverse=True)
        raw, known, found = data.tobytes(), self._known, []
        for a, z in zip(begin[at].tolist(), end[at].tolist()):
            s = raw[a:z]
            got = known(s)
            found.append(self._keep(s, self._stretch(s)) if got is None else got)
        sizes = np.array([len(x) for x in found], np.int64) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[which]
        upto = np.append(0, np.cumsum(n))
        every = ids[np.repeat(starts[which] - upto[:-1], n) + np.arange(int(upto[-1]))]
        rows = upto[np.searchsorted(begin, offsets)].tolist()
        return [every[a:z].tobytes() for a, z in zip(rows, rows[1:])]

    def rows(self, column: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; null texts are empty."""
        if not self.plain:
            return [self._library(t or "") for t in column.to_pylist()]
        data, offsets = utf8(column)
        out: list[bytes] = []
        for a, z in words.slices(offsets, self.SLICE):
            part, own = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
            if len(part):
                out += self._slice(part, own)
            else:
                out += [b""] * (z - a)
            raw = part.tobytes()
            for token in {t.encode() for t in self.added}:
                place = raw.find(token)
                while place >= 0:  # a text with an added token, or one that runs into the next text
                    row = int(np.searchsorted(own, place, "right")) - 1
                    out[a + row] = self._library(raw[own[row] : own[row + 1]].decode())
                    place = raw.find(token, max(place + 1, int(own[row + 1])))
        return out

    def encode(self, text: str) -> bytes:
        return self.rows(pa.array([text], pa.string()))[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def hashes(ids: Iterable[int | None], numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each key."""
    values = np.array([(1 << 63) ^ 0x5BD1E995 if i is None else i & (1 << 64) - 1 for i in ids], np.uint64)
    return mix64(values * np.uint64(0x9E3779B97F4A7C15) + mix64(numbers.astype(np.uint64) + np.uint64(1)))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit numbers: at each level, keys alone at their bit have found their slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.append(0, np.cumsum([int(x.sum()) for x in levels]))
        self.rank = [np.cumsum(x) - x for x in levels]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0xD6E8FEB86659FD93 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) >= LEVELS:
                raise ValueError("keys are not distinct")
            size = int(len(left) * GAMMA) + 8
            at = cls._at(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't there, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            at = self._at(keys[open_], i, len(level))
            hit = level[at]
            out[open_[hit]] = self.before[i] + self.rank[i][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @staticmethod
    def ranks(bits: bytes) -> bytes:
        """Of dumped bits, the ones before each block of RANKED bytes: with them a slot takes the bytes of one block."""
        ones = np.bitwise_count(np.frombuffer(bits, np.uint8))
        return (np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), RANKED), dtype=np.int64)) if len(ones) else np.zeros(0, np.int64)).astype("<u4").tobytes()

    @classmethod
    def slot(cls, key: np.ndarray, bits: memoryview, sizes: list[int], ranks: memoryview) -> int:
        """The slot of one key, a 64-bit number in an array, from dumped bits: a bit for each level up to its own, and one block."""
        base = 0
        for i, n in enumerate(sizes):
            at = int(cls._at(key, i, n)[0])
            byte, bit = base + at // 8, at % 8
            if bits[byte] & 0x80 >> bit:
                block = byte // RANKED
                before = int.from_bytes(ranks[4 * block - 4 : 4 * block], "little") if block else 0
                return before + int.from_bytes(bits[block * RANKED : byte], "little").bit_count() + (bits[byte] >> (8 - bit)).bit_count()
            base += (n + 7) // 8
        return -1

    @classmethod
    def load(cls, data: bytes, sizes: list[int]) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
            at += (n + 7) // 8
        return cls(levels)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


SHARDS = "part int, seq int, n_ids long, n_docs long, first_key long, last_key long, keys array<long>, numbers array<int>, bits binary, sizes array<long>, ranks binary, fingerprints binary, starts binary, counts binary, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("keys", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int32())), ("bits", pa.binary()), ("sizes", pa.list_(pa.int64())), ("ranks", pa.binary()), ("fingerprints", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()), ("payload", pa.binary())])


def _shard(part: int, seq: int, keys: list[int | None], numbers: list[int], pieces: list[bytes]) -> pa.RecordBatch:
    counts = np.array([len(p) // 4 for p in pieces], np.int64)
    starts = np.cumsum(counts) - counts
    h = hashes(keys, np.array(numbers, np.int64))
    mph = PerfectHash.build(h)
    slot = mph.slots(h)
    prints, s, c = np.empty(len(h), "<u4"), np.empty(len(h), "<u8"), np.empty(len(h), "<u4")
    prints[slot], s[slot], c[slot] = fingerprints(h), starts, counts
    bits, sizes = mph.dump()
    known = [k for k in keys if k is not None]
    row = {"part": part, "seq": seq, "n_ids": int(counts.sum()), "n_docs": len(keys), "first_key": known[0] if known else None, "last_key": known[-1] if known and len(known) == len(keys) else None, "keys": keys, "numbers": numbers, "bits": bits, "sizes": sizes, "ranks": PerfectHash.ranks(bits), "fingerprints": prints.tobytes(), "starts": s.tobytes(), "counts": c.tobytes(), "payload": b"".join(pieces)}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def write(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode docs and write the shards; returns the table that was written. Range partitions by key bound every task."""
    path, most = tokenizer or default_tokenizer(), SHARD_IDS
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([END], "<u4").tobytes()
        keys, numbers, pieces, held, last = [], [], [], 0, None
        for b in batches:
            for k, ids in zip(b.column(key).to_pylist(), enc.rows(b.column(text))):
                count = numbers[-1] + 1 if keys and keys[-1] == k else last[1] + 1 if last is not None and last[0] == k and not keys else 0
                raw = ids + end
                if keys and held + len(raw) // 4 > most:
                    yield _shard(part, seq, keys, numbers, pieces)
                    count = numbers[-1] + 1 if keys[-1] == k else 0
                    keys, numbers, pieces, held, seq = [], [], [], 0, seq + 1
                keys.append(k)
                numbers.append(count)
                pieces.append(raw)
                held += len(raw) // 4
                last = (k, count)
        if keys:
            yield _shard(part, seq, keys, numbers, pieces)

    order = [F.col(key).asc_nulls_last(), F.col(text).asc_nulls_last()]
    # rows of one id stay together: the range is by id alone, and only rows of one id share a key
    dealt = docs.select(key, text).repartitionByRange(n, order[0]).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, T.StructType.fromDDL(SHARDS)), "shards")


def _open(row: dict) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
    return PerfectHash.load(row["bits"], row["sizes"]), np.frombuffer(row["fingerprints"], "<u4"), np.frombuffer(row["starts"], "<u8"), np.frombuffer(row["counts"], "<u4")


def find(row: dict, keys: list[int | None], numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key whether the shard has it, and its start and count in the payload, in ids."""
    mph, prints, starts, counts = _open(row)
    h = hashes(keys, np.zeros(len(keys), np.int64) if numbers is None else numbers)
    slot = mph.slots(h)
    there = slot >= 0
    if len(prints):
        there &= prints[slot] == fingerprints(h)
        return there, starts[slot].astype(np.int64), counts[slot].astype(np.int64)
    return there, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)


def place(row: dict, key: int | None, number: int = 0) -> tuple[int, int] | None:
    """Start and count, in ids, of one key in a shard, or None: reads a bit for each level, a block of bits, and the slot's own bytes."""
    h = hashes([key], np.array([number], np.int64))
    slot = PerfectHash.slot(h, *(memoryview(row["bits"]), row["sizes"], memoryview(row["ranks"])))
    of = lambda name, size: int.from_bytes(memoryview(row[name])[size * slot : size * slot + size], "little")
    if slot < 0 or of("fingerprints", 4) != int(fingerprints(h)[0]):
        return None
    return of("starts", 8), of("counts", 4)


READ = "doc_id long, number int, part int, seq int, local long, n_tokens long, ids_crc32 long, found boolean"


def read_all(shards: DataFrame) -> DataFrame:
    """Every key's ids read back by the index: READ, a row for each document."""

    def run(batches):
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            for row in b.to_pylist():
                keys, numbers = row["keys"], np.array(row["numbers"], np.int64)
                there, start, count = find(row, keys, numbers)
                payload = memoryview(row["payload"])
                crcs = [zlib.crc32(payload[4 * s : 4 * (s + c)]) for s, c in zip(start.tolist(), count.tolist())]
                n = len(keys)
                cols = [pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), pa.array(start), pa.array(count), pa.array(crcs, pa.int64()), pa.array(there)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return shards.mapInArrow(run, T.StructType.fromDDL(READ))


def lookup(shards: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ids of the wanted documents that are there (the first row of an id). A key can be in the last shard that
    begins before it, or in the first that begins with it. Shard bounds and keys are dealt by range of keys; what goes from
    one range to the next is one row for each range."""
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = shards.filter("first_key is not null").select(F.col("first_key").alias("k"), F.struct("part", "seq").alias("shard"), F.lit(1).alias("kind"))
    wanted = keys.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.lit(None).cast("struct<part:int,seq:int>").alias("shard"), F.lit(0).alias("kind")).distinct()
    dealt = materialize(bounds.unionByName(wanted).repartitionByRange(n, "k").withColumn("range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("range").orderBy("k", "kind", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = dealt.groupBy("range").agg(F.max("shard").alias("last"))  # shards ascend with their keys
    ahead = last.select("range", F.last("last", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))
    inside = dealt.withColumn("inside", F.last("shard", ignorenulls=True).over(own)).filter("kind = 0").join(ahead, "range")
    before = inside.select("k", F.coalesce("inside", "ahead").alias("to")).filter("to is not null")
    begins = bounds.groupBy("k").agg(F.min("shard").alias("to")).join(wanted.select("k"), "k")
    routed = before.unionByName(begins.select("k", "to")).groupBy(F.col("to.part").alias("part"), F.col("to.seq").alias("seq")).agg(F.collect_set("k").alias("wanted"))

    def placed(batches):
        for b in batches:
            rows = []
            for row in b.to_pylist():
                found = [(k, place(row, k)) for k in row["wanted"]]
                rows.append((row["part"], row["seq"], [{"k": k, "start": p[0], "count": p[1]} for k, p in found if p]))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.struct([("k", pa.int64()), ("start", pa.int64()), ("count", pa.int64())])))], names=["part", "seq", "places"])

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in b.column("raw").to_pylist()], pa.list_(pa.int64()))], names=[key, "ids"])

    index = shards.select("part", "seq", "bits", "sizes", "ranks", "fingerprints", "starts", "counts").join(routed, ["part", "seq"])
    places = index.mapInArrow(placed, "part int, seq int, places array<struct<k:bigint,start:bigint,count:bigint>>").filter(F.size("places") > 0)
    # of a payload only the wanted slices leave the executor's JVM
    slices = F.transform("places", lambda p: F.struct(p["k"].alias("k"), F.substring(F.col("payload"), (p["start"] * 4 + 1).cast("int"), (p["count"] * 4).cast("int")).alias("raw")))
    cut = shards.select("part", "seq", "payload").join(places, ["part", "seq"]).select(F.explode(slices).alias("x")).select(F.col("x.k").alias(key), F.col("x.raw").alias("raw"))
    return cut.mapInArrow(read, T.StructType([T.StructField(key, T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))]))


def starts(shards: DataFrame) -> DataFrame:
    """READ's columns with start, the number of ids of all documents before, for every key of the shards."""
    # ids before each shard: partitions' sums first, so that a window holds one partition's shards, or one row for each partition
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("all"))
    ahead = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    before = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("inside")).join(ahead, "part")
    read = read_all(shards).join(before.select("part", "seq", (F.col("inside") + F.col("ahead")).alias("before")), ["part", "seq"])
    return read.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", F.col("part").alias("shard"), "seq", "found")


def op2(spark, sf_dir: str) -> DataFrame:
    return starts(write(table(spark, sf_dir, "documents")))
