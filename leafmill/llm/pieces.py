"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text's pieces form a lattice: an edge for each vocabulary piece that stands at a place. Forward filtering sums the
weights of all ways to each place; backward sampling draws the last piece of the text by those sums, then the one before
it, and so on, so that a segmentation comes up with its share of all weights. The draws come from a counter-based
generator keyed by the row's key, the place in the text and the step: the same key and text give the same pieces on any
cluster, in any partition.

The vocabulary's merge scores are ranks; a piece's weight is that of Zipf's law, (1 + rank) ** -theta. theta = 1 samples,
a large theta tends to the one best segmentation. A character that no piece covers goes to its UTF-8 bytes, and so does a
U+2581 of the text itself, which would else decode to a space.

No piece has a word mark after another character, so the lattice falls apart before each mark (a run of spaces stays with
the word after it); equal words of a batch share one lattice.

Nulls and odd input: a null text has null ids and decodes to null; an empty one has none and decodes to ''. A null key
draws as a key of its own. Repeated rows with one key get the same pieces. Long texts are never cut.
Other columns stay and may have any names; one called like the column of ids is replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BASE, INVERSE, mix64, powers, table

MARK = 0x2581
_OWN_MARK = 0x110000  # stands for a U+2581 of the text
#: Characters that are worked on at once.
CHUNK = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces as a trie in an open hash table, with weights."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        words: list[tuple[list[int], int, float]] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
                rank = -sp.get_score(i)
                words.append(([ord(c) for c in piece], i, -theta * np.log1p(min(max(rank, 0.0), size))))
        self.byte_weight = -theta * np.log1p(size)
        edges: dict[tuple[int, int], int] = {}
        piece_at, weight_at = [-1], [0.0]
        self.longest = 0
        for chars, i, w in words:
            node = 0
            for c in chars:
                if (node, c) not in edges:
                    edges[node, c] = len(piece_at)
                    piece_at.append(-1)
                    weight_at.append(0.0)
                node = edges[node, c]
            piece_at[node], weight_at[node] = i, w
            self.longest = max(self.longest, len(chars))
        self.piece_at, self.weight_at = np.array(piece_at, np.int32), np.array(weight_at)
        bits = max(10, (4 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for (node, c), to in edges.items():
            key = node << 21 | c
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.next[at] = key, to
        self.single = {chars[0] for chars, *_ in words if len(chars) == 1}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node for each pair, or 0."""
        key = node.astype(np.int64) << 21 | char
        at = self._slot(key)
        out = np.zeros(len(key), np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            have = self.keys[at]
            hit = have == key
            out[open_[hit]] = self.next[at[hit]]
            go = ~hit & (have >= 0)
            open_, at, key = open_[go], (at[go] + 1) & self.mask, key[go]
        return out


class Lattice:
    """The lattices of many words at once. `chars` holds the words one after another; `start` and `length` say where."""

    def __init__(self, vocab: Vocabulary, chars: np.ndarray, start: np.ndarray, length: np.ndarray):
        n = len(chars)
        place = np.arange(n) - np.repeat(start, length)  # within its word
        left = np.repeat(length, length) - place
        node, at = np.zeros(n, np.int32), np.arange(n)
        froms, tos, ids, weights = [], [], [], []
        known = np.zeros(n, bool)
        for k in range(1, vocab.longest + 1):
            node = vocab.step(node, chars[at + k - 1])
            live = node > 0
            node, at = node[live], at[live]
            ends = vocab.piece_at[node] >= 0
            f = at[ends]
            if k == 1:
                known[f] = True
            froms.append(f)
            tos.append(f + k)
            ids.append(vocab.piece_at[node[ends]])
            weights.append(vocab.weight_at[node[ends]])
            room = left[at] > k
            node, at = node[room], at[room]
            if not len(at):
                break
        lost = np.flatnonzero(~known)  # goes to bytes
        code = np.where(chars[lost] == _OWN_MARK, MARK, chars[lost])
        count = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        froms.append(lost)
        tos.append(lost + 1)
        ids.append((-1 - code).astype(np.int32))
        weights.append(count * vocab.byte_weight)
        f, t, i, w = map(np.concatenate, (froms, tos, ids, weights))
        # an edge ends "after" a character: group by its last character, in the order of places within words
        last = t - 1
        order = np.lexsort((last, place[last]))
        f, last, self.id, w = f[order], last[order], i[order], w[order]
        fresh = np.append(True, last[1:] != last[:-1]) if len(last) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        self.first = np.zeros(n + 1, np.int64)
        self.first[last[first]] = first
        self.begin = f
        inside = place[f] > 0
        alpha = np.zeros(n)
        self.cumulative = np.empty(len(f))
        level = place[last[first]]
        bounds = np.append(np.searchsorted(level, np.arange(level[-1] + 2 if len(level) else 1)), len(first))
        sizes = np.append(first, len(f))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            e0, e1 = sizes[a], sizes[b]
            v = w[e0:e1] + np.where(inside[e0:e1], alpha[f[e0:e1] - 1], 0.0)
            heads, own = first[a:b] - e0, group[e0:e1] - a
            top = np.maximum.reduceat(v, heads)
            p = np.exp(v - top[own])
            total = np.add.reduceat(p, heads)
            alpha[last[first[a:b]]] = top + np.log(total)
            run = np.cumsum(p)
            run -= (run[heads] - p[heads])[own]
            self.cumulative[e0:e1] = run / total[own]
        # the last edge of each group takes what rounding leaves
        self.cumulative[np.append(first[1:], len(f))[: len(first)] - 1] = 2.0


def _units(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where words begin: at heads, the beginnings of texts, and at each mark after another character."""
    mark = points == MARK
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    begins[heads] = True
    return np.flatnonzero(begins)


def encode(vocab: Vocabulary, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
    """The ids of each text; keys: uint64, one for each text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        room, j = 0, i
        while j < len(texts) and (j == i or room + len(texts[j]) < CHUNK):
            room += len(texts[j]) + 1
            j += 1
        out += _encode(vocab, texts[i:j], keys[i:j], seed)
        i = j
    return out


def _encode(vocab: Vocabulary, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
    full = [i for i, t in enumerate(texts) if t]
    result = [np.zeros(0, np.int32)] * len(texts)
    if not full:
        return result
    points = np.frombuffer("".join(" " + texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(points == MARK, _OWN_MARK, np.where(points == 32, MARK, points))
    sizes = np.array([len(texts[i]) + 1 for i in full])
    heads = np.cumsum(sizes) - sizes
    start = _units(points, heads)
    length = np.diff(np.append(start, len(points)))
    # equal words: by a hash, then held against each other
    for attempt in range(4):
        sums = np.empty(len(points) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(attempt * 0x5DEECE66D + 1)) * powers(BASE, len(points)), out=sums[1:])
        h = mix64((sums[start + length] - sums[start]) * powers(INVERSE, len(points))[start] + length.astype(np.uint64))
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        if (length[one][which] == length).all():
            shift = np.repeat(start[one][which] - start, length)
            if (points[np.arange(len(points)) + shift] == points).all():
                break
    else:
        one = which = np.arange(len(start))
    size = length[one]
    base = np.cumsum(size) - size
    chars = points[np.repeat(start[one] - base, size) + np.arange(size.sum())]
    lattice = Lattice(vocab, chars, base, size)
    # sampling, for all words at once, from their ends
    owner = np.repeat(np.arange(len(full)), np.diff(np.append(np.searchsorted(start, heads), len(start))))
    within = np.arange(len(start)) - np.searchsorted(start, heads)[owner]
    state = mix64(keys[full][owner] + mix64(within.astype(np.uint64) + np.uint64(seed * 0xD1342543DE82EF95 % 2**64)))
    live = np.arange(len(start))
    low, at = base[which], base[which] + size[which] - 1
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(start), np.int64)
    while len(live):
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        u = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = lattice.first[at]
        more = np.flatnonzero(lattice.cumulative[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[lattice.cumulative[edge[more]] <= u[more]]
        steps.append((live, edge))
        code = -1 - lattice.id[edge].astype(np.int64)
        count[live] += np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        at = lattice.begin[edge] - 1
        go = at >= low
        live, at, low, state = live[go], at[go], low[go], state[go]
    ends = np.cumsum(count)
    ids = np.zeros(ends[-1], np.int32)
    free = ends.copy()
    for who, edge in steps:
        piece = lattice.id[edge]
        plain = piece >= 0
        free[who[plain]] -= 1
        ids[free[who[plain]]] = piece[plain]
        for w, p in zip(who[~plain].tolist(), piece[~plain].tolist()):
            raw = chr(-1 - p).encode("utf-8", "surrogatepass")
            free[w] -= len(raw)
            ids[free[w] : free[w] + len(raw)] = vocab.byte[list(raw)]
    per_text = np.add.reduceat(count, np.searchsorted(start, heads))
    for i, part in zip(full, np.split(ids, np.cumsum(per_text)[:-1])):
        result[i] = part
    return result


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids, exactly as it was encoded."""
    raw = b"".join([vocab.bytes[i] for i in ids.tolist()])
    return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


_VOCABULARIES: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, theta: float) -> Vocabulary:
    """Kept for each process."""
    if (path, theta) not in _VOCABULARIES:
        _VOCABULARIES[path, theta] = Vocabulary(path, theta)
    return _VOCABULARIES[path, theta]


def row_keys(column: pa.Array) -> np.ndarray:
    """A number for each key, the same on any machine."""
    return np.array([int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "big") for x in column.to_pylist()], np.uint64)


def with_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", into: str = "ids", seed: int = 29, theta: float = 1.0, model: str | None = None) -> DataFrame:
    """docs with an array of the sampled ids of each text."""
    path = model or default_model()

    def run(batches):
        vocab = vocabulary(path, theta)
        for b in batches:
            texts = b.column(text).to_pylist()
            ids = encode(vocab, [t or "" for t in texts], row_keys(b.column(key)), seed)
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32))
            made = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, into])

    return docs.drop(into).mapInArrow(run, T.StructType([*docs.drop(into).schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def with_text(docs: DataFrame, ids: str = "ids", into: str = "text", model: str | None = None) -> DataFrame:
    """docs with the text that each array of ids decodes to."""
    path = model or default_model()

    def run(batches):
        vocab = vocabulary(path, 1.0)
        for b in batches:
            lists = b.column(ids)
            at, flat, valid = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False), lists.is_valid().to_pylist()
            made = [decode(vocab, flat[at[i] : at[i + 1]]) if ok else None for i, ok in enumerate(valid)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, into])

    return docs.drop(into).mapInArrow(run, T.StructType([*docs.drop(into).schema.fields, T.StructField(into, T.StringType())]))


def roundtrip(docs: DataFrame, text: str = "text", key: str = "doc_id", into: str = "ids", seed: int = 29, theta: float = 1.0, model: str | None = None) -> DataFrame:
    """docs with the sampled ids of each text, and as text what they decode to: with_ids and with_text in one pass."""
    path = model or default_model()
    docs = docs.drop(into)

    def run(batches):
        vocab = vocabulary(path, theta)
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b = whole.slice(i, 128)
                texts = b.column(text).to_pylist()
                ids = encode(vocab, [t or "" for t in texts], row_keys(b.column(key)), seed)
                back = pa.array([None if t is None else decode(vocab, x) for t, x in zip(texts, ids)], pa.string())
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32))
                made = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*(back if n == text else b.column(n) for n in b.schema.names), made], names=[*b.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


DIGEST = "n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 29, theta: float = 1.0, model: str | None = None) -> DataFrame:
    """key and DIGEST: the sampled ids as little-endian 32-bit integers, and the text that they decode to."""
    path = model or default_model()

    def run(batches):
        vocab = vocabulary(path, theta)
        for b in batches:
            texts = b.column(text).to_pylist()
            ids = encode(vocab, [t or "" for t in texts], row_keys(b.column(key)), seed)
            back = [decode(vocab, x) for x in ids]
            cols = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back], pa.string()),
                pa.array([t == (was or "") for t, was in zip(back, texts)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(key), *cols], names=[key, *(x.split()[0] for x in DIGEST.split(", "))])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], *T.StructType.fromDDL(DIGEST).fields]))


def op5(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
