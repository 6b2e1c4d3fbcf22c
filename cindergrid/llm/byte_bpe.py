"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others.

Texts are cut into pre-tokens on their UTF-8 bytes by the public split pattern (contractions; letters, digits or other
signs with one leading blank; white space), which is restated here as run boundaries so that no Python object is made
per pre-token. All pre-tokens of a slice are looked up at once in a minimal perfect hash of the vocabulary (a hit is
decided by the 64-bit hash stored at the slot). Each distinct miss of a slice is merged once: its bytes form a linked
list, and a heap yields the adjacent pair of lowest rank. Ids travel packed, as little-endian unsigned 32-bit integers.
Null and empty texts have no ids; repeated rows and ids are encoded each; extra columns are ignored.
The vocabulary (bounded by its file) is broadcast.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cindergrid.llm import arrays, sharing

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: Fixed values of the split pattern: what may follow an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Longest miss that is merged in lock-step with others.
TOGETHER = 64
#: Rank of a pair that isn't in the vocabulary, above all others.
NONE = 1 << 24
#: Slots of a worker's memory of merged misses, and the most ids of one that is kept there.
SLOTS, KEPT = 1 << 19, 6


def character_classes() -> np.ndarray:
    """The pattern's class of every code point."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, points):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            table[a:b] = kind
    return table


def byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    kind = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        width = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int64) & (0x7F >> width)
        for j in range(1, 4):
            more = width > j
            point[more] = point[more] << 6 | data[lead[more] + j] & 0x3F
        own = table[point]
        for j in range(4):
            more = width > j
            kind[lead[more] + j] = own[more]
    return kind


def pretokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every pre-token (and the end of the last), and the first pre-token of every row."""
    n = len(data)
    kind = byte_classes(data, table)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # Of white space before a word, the last character stands alone; a blank joins the word.
    word = np.flatnonzero(start[1:] & ~edge[1:-1] & (kind[:-1] == SPACE)) + 1
    last = word - 1
    for _ in range(3):
        last = np.where(data[last] & 0xC0 == 0x80, last - 1, last)
    start[last] = True
    start[word[data[word - 1] == 32]] = False
    quote = np.flatnonzero(start & (data == 39))
    for tail in CONTRACTIONS:
        k = len(tail)
        at = quote[quote + k < n]
        for j, c in enumerate(tail.encode(), 1):
            at = at[(data[at + j] == c) & ~edge[at + j]]
        start[at + 1] = False
        after = at + k + 1
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    return np.append(starts, n), np.searchsorted(starts, offsets)


class Vocabulary:
    """Tables made from the ranks of all entries; a few MB for 50,000 of them."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = list(ranks)
        ids = np.array(list(ranks.values()))
        self.lengths = np.zeros(ids.max() + 1, np.int64)
        self.lengths[ids] = [len(t) for t in tokens]
        by_id = sorted(ranks.items(), key=lambda t: t[1])
        self.bytes = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths
        text = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([len(t) for t in tokens])
        self._perfect(arrays.hashes(text, ends - [len(t) for t in tokens], ends), ids)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, rank in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.classes = character_classes()
        self.memory = None

    def _slot(self, h, d):
        with np.errstate(over="ignore"):
            return arrays.mix(h + d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.size)

    def _perfect(self, h: np.ndarray, ids: np.ndarray) -> None:
        """Place every key in a slot of its own among as many slots as keys: each bucket gets the first displacement that
        moves all its keys to free slots, large buckets first; a bucket of one key names its slot, as -1 - slot."""
        self.size, self.buckets = len(h), len(h) // 3 + 1
        bucket = (h >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        many = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
        first = np.cumsum(many) - many
        self.moves = np.zeros(self.buckets, np.int64)
        self.slot_hash, self.slot_id = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64)
        free = np.ones(self.size, bool)
        for b in np.argsort(-many, kind="stable"):
            keys = order[first[b] : first[b] + many[b]]
            if len(keys) < 2:
                break
            at = 0
            while True:
                d = np.arange(at, at + 32)
                slots = self._slot(h[keys][None, :], d[:, None]).astype(np.int64)
                good = free[slots].all(1)
                for k in np.flatnonzero(good):
                    if len(set(slots[k].tolist())) == len(keys):
                        break
                else:
                    at += 32
                    continue
                self.moves[b], free[slots[k]] = d[k], False
                self.slot_hash[slots[k]], self.slot_id[slots[k]] = h[keys], ids[keys]
                break
        lone = np.flatnonzero(many == 1)
        slots = np.flatnonzero(free)[: len(lone)]
        keys = order[first[lone]]
        self.moves[lone], self.slot_hash[slots], self.slot_id[slots] = -1 - slots, h[keys], ids[keys]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of each pre-token hash, -1 where it isn't a whole entry."""
        move = self.moves[((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(move < 0, -1 - move, self._slot(h, np.maximum(move, 0)).astype(np.int64))
        return np.where(self.slot_hash[slot] == h, self.slot_id[slot], -1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pairs (a, b), or NONE."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(ids[:-1], ids[1:])
        known = np.flatnonzero(ranks < NONE)
        heap = (ranks[known] << 32 | known).tolist()
        ids = ids.tolist()
        heapq.heapify(heap)

        def pair(x, y):
            if (r := int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])) < NONE:
                heapq.heappush(heap, r << 32 | x)

        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if ids[i] < 0 or (j := after[i]) >= n or int(self.rank(np.array([ids[i]]), np.array([ids[j]]))[0]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair(i, k)
            if before[i] >= 0:
                pair(before[i], i)
        return [t for t in ids if t >= 0]

    def merge_all(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many short pieces in lock-step; ids of all pieces and their counts.

        Every piece has a heap of its own: a tournament tree over its bytes, whose leaf i holds rank and place of the pair
        that starts at byte i, so that its root is the next merge. A merge changes three leaves and their paths."""
        m, w = len(starts), 1 << max(1, int(lengths.max() - 1).bit_length())
        place = np.arange(w, dtype=np.int32)
        bits = w.bit_length() - 1
        inside = place < lengths[:, None]
        ids = np.where(inside, self.single[data[np.minimum(starts[:, None] + place, len(data) - 1)]], -1)
        after = np.where(place + 1 < lengths[:, None], place + 1, w) + np.zeros((m, 1), np.int32)
        before = np.broadcast_to(place - 1, (m, w)).copy()
        tree = np.full((m, 2 * w), NONE * w, np.int32)
        both = inside[:, 1:] & inside[:, :-1]
        leaves = np.full((m, w), NONE * w, np.int32)
        leaves[:, :-1][both] = self.rank(ids[:, :-1][both], ids[:, 1:][both]) * w
        tree[:, w:] = leaves + place
        for node in range(w - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        row = np.arange(m)
        while True:
            top = tree[row * 2 * w + 1]
            live = top < NONE * w
            if not live.all():
                row, top = row[live], top[live]
            if not len(row):
                break
            flat, root = row * w, row * 2 * w
            i = top & (w - 1)
            merged = top >> bits
            j = after[flat + i]
            k = after[flat + j]
            ids[flat + i], ids[flat + j], after[flat + i] = merged, -1, k
            more = k < w
            before[(flat + k)[more]] = i[more]
            left, right = np.full(len(row), NONE, np.int32), np.full(len(row), NONE, np.int32)
            right[more] = self.rank(merged[more], ids[(flat + k)[more]])
            p = before[flat + i]
            more = p >= 0
            left[more] = self.rank(ids[(flat + p)[more]], merged[more])
            p = np.where(more, p, j)
            tree[root + w + i] = right * w + i
            tree[root + w + j] = NONE * w + j
            tree[root + w + p] = left * w + p
            a, b, c = w + i, w + j, w + p
            for _ in range(bits):
                a, b, c = a >> 1, b >> 1, c >> 1
                for x in (a, b, c):
                    tree[root + x] = np.minimum(tree[root + 2 * x], tree[root + 2 * x + 1])
        keep = (ids >= 0).reshape(m, w)
        return ids[ids >= 0].astype(np.uint32), keep.sum(1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the first id of every row."""
        starts, first = pretokens(data, offsets, self.classes)
        h = arrays.hashes(data, starts[:-1], starts[1:])
        found = self.find(h)
        miss = np.flatnonzero(found < 0)
        counts = np.ones(len(h), np.int64)
        flat, at, sizes = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(miss):
            own, example, which = np.unique(h[miss], return_index=True, return_inverse=True)
            begin, length = starts[miss[example]], np.diff(starts)[miss[example]]
            if self.memory is None:
                self.memory = np.zeros(SLOTS, np.uint64), np.zeros((SLOTS, KEPT), np.uint32), np.zeros(SLOTS, np.int8)
            key, kept, many = self.memory
            slot = (own % np.uint64(SLOTS)).astype(np.int64)
            seen = key[slot] == own
            at, sizes = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            sizes[seen] = many[slot[seen]]
            at[seen] = np.cumsum(sizes[seen]) - sizes[seen]
            flat.append(kept[slot[seen]][np.arange(KEPT) < sizes[seen][:, None]])
            base = len(flat[0])
            low = 0
            for high in (4, 8, 16, 32, TOGETHER):
                group = np.flatnonzero((length > low) & (length <= high) & ~seen)
                for part in np.array_split(group, len(group) // 16384 + 1):
                    if len(part):
                        ids, sizes[part] = self.merge_all(data, begin[part], length[part])
                        at[part] = base + np.cumsum(sizes[part]) - sizes[part]
                        base += len(ids)
                        flat.append(ids)
                low = high
            for x in np.flatnonzero(length > TOGETHER):
                ids = np.array(self.merge(data[begin[x] : begin[x] + length[x]].tobytes()), np.uint32)
                at[x], sizes[x], base = base, len(ids), base + len(ids)
                flat.append(ids)
            flat = np.concatenate(flat)
            new = np.flatnonzero(~seen & (sizes <= KEPT))
            key[slot[new]], many[slot[new]] = own[new], sizes[new]
            for j in range(KEPT):
                kept[slot[new], j] = flat[np.minimum(at[new] + j, len(flat) - 1)]
            counts[miss] = sizes[which]
        place = np.append(0, np.cumsum(counts))
        out = np.zeros(place[-1], np.uint32)
        hit = found >= 0
        out[place[:-1][hit]] = found[hit]
        if len(miss):
            out[ranges(place[:-1][miss], counts[miss])] = flat[ranges(at[which], counts[miss])]
        return out, place[first]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.places[ids], self.lengths[ids])].tobytes()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + lengths, lengths)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read a file of base64 entries and their ranks."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (binary, packed) of every row; ``path`` is a file of base64 entries and their ranks."""
    model = sharing.share(docs.sparkSession, vocabulary(path))

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in arrays.slices(batch.column(1)):
                ids, first = sharing.use(model).encode(data, offsets)
                raw = pa.py_buffer(ids.astype("<u4"))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer(4 * first.astype(np.int64)), raw])
                yield pa.record_batch([batch.column(0).slice(row, end - row), packed.cast(pa.binary())], [id_col, "ids"])
            arrays.give_back()

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary, UTF-8) to a table with packed ``ids``; null ids decode to nothing."""
    model = sharing.share(encoded.sparkSession, vocabulary(path))
    at = encoded.columns.index("ids")
    columns = [*encoded.columns, "decoded"]

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                texts = [sharing.use(model).decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in part.column(at)]
                yield pa.record_batch([*part.columns, arrays.binary(texts)], columns)
            arrays.give_back()

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
