"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted verification.

The benchmark is a stated query set. It is taken in blocks of bounded bytes, each searched against all documents in one
pass. A fingerprint has 64 bits, each the majority vote of one bit of the hashes of all two-word shingles of a window.
Item lengths are rounded down to sizes that grow by a quarter; for every size, windows of that many words are slid over
the whole text by one word and compared with as many first words of the items (a text shorter than the size is one
window, compared with whole items). A fingerprint is cut into four blocks of 16 bits: if two fingerprints differ in at most
``RADIUS`` bits, some block differs in at most a quarter of them, so looking each block up among all values that near
to an item's block loses no fingerprint within the radius. Candidates within the radius are then compared exactly: the
similarity is the weighted Jaccard of five-word shingle bags, a shingle weighing as many as it has distinct words.

Edits of a near copy may move its fingerprint by more than any radius that still tells texts apart, so fingerprints alone
would miss some. A second look-up misses none: a window of similarity t shares at least t of an item's weight, so it
holds one of the item's ``probes``, shingles that together weigh more than 1 - t of it (those of the fewest items). All
windows of a row that holds a probe are compared exactly at once, by running sums; also those cut off by the row's end.

Null and empty texts and items match nothing. Items of one word have one-word shingles. Repeated rows, ids and null ids
are searched row by row; of equally similar windows any may be reported. Empty tables give no matches.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cindergrid.llm import arrays, sharing

RADIUS = 11
#: Bytes of benchmark text searched in one pass over the documents.
BLOCK = 1 << 20
#: Words whose votes are held at once.
VOTES = 32768
#: Candidates of windows that are compared at once; one window never has more than the items of its size.
PIECE = 1 << 20


def _near() -> np.ndarray:
    """All 16-bit masks with at most a quarter of the radius set."""
    return np.array([sum(1 << i for i in c) for k in range(RADIUS // 4 + 1) for c in combinations(range(16), k)], np.uint16)


def _slots(prints: np.ndarray, blocks: int, near: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the first ``blocks`` blocks of 16 bits the items near to every block value: the items of value x are
    ``items[ends[x] : ends[x + 1]]``; ``held`` tells values that have any."""
    out = []
    for part in prints.view(np.uint16).reshape(-1, 4).T[:blocks]:
        at = (part[:, None] ^ near).ravel()
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange((1 << 16) + 1))
        out.append((ends, (order // len(near)).astype(np.int32), ends[1:] > ends[:-1]))
    return out


def _candidates(slots, found: np.ndarray):
    """Windows and items that share a block value, in pieces of about ``PIECE`` candidates."""
    parts = found.view(np.uint16).reshape(-1, 4)
    some = np.flatnonzero(sum(held.take(parts[:, b]) for b, (_, _, held) in enumerate(slots)))
    low = [ends[parts[some, b]] for b, (ends, _, _) in enumerate(slots)]
    many = [ends[parts[some, b].astype(np.int64) + 1] - low[b] for b, (ends, _, _) in enumerate(slots)]
    before = np.concatenate([[0], np.cumsum(sum(many))])
    a = 0
    while a < len(some):
        z = max(a + 1, int(np.searchsorted(before, before[a] + PIECE, side="right")) - 1)
        which, item = [], []
        for (_, items, _), start, n in zip(slots, low, many):
            start, n = start[a:z], n[a:z]
            which.append(np.repeat(some[a:z], n))
            item.append(items[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)])
        yield np.concatenate(which), np.concatenate(item)
        a = z


def votes(h: np.ndarray, wide: bool) -> np.ndarray:
    """Running sums of the bits of all two-word shingles of the words ``h``, 64 counters side by side in one row of 64-bit
    integers. Carries between counters cancel in differences, as long as a window's counts fit a counter."""
    with np.errstate(over="ignore"):
        pairs = arrays.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    kind = np.uint32 if wide else np.uint8
    bits = np.unpackbits(pairs.view(np.uint8)).astype(kind, copy=False).view(np.uint64).reshape(len(pairs), 8 * np.dtype(kind).itemsize)
    return np.cumsum(np.concatenate([np.zeros((1, bits.shape[1]), np.uint64), bits]), axis=0, dtype=np.uint64)


def fingerprint(total: np.ndarray, m: int) -> np.ndarray:
    """SimHash of every ``m`` consecutive words."""
    d = (total[m - 1 :] - total[: len(total) - m + 1]).view(np.uint8 if total.shape[1] == 8 else np.uint32)
    return np.packbits((d > (m - 1) // 2).ravel()).view(np.uint64)


def size_class(m: int) -> int:
    """The largest of the sizes 1, 2, 3, ... (each a quarter more than the one before, rounded up) up to ``m``."""
    size = 1
    while (more := size + -(-size // 4)) <= m:
        size = more
    return size


def weights(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the words ``h`` and their weights."""
    k = min(width, len(h))
    g = arrays.windows(h, width)
    views = np.sort(np.lib.stride_tricks.sliding_window_view(h, k), axis=1)
    return g, 1 + (views[:, 1:] != views[:, :-1]).sum(1)


class Item:
    """The shingle bag of an item of at least ``width`` words: distinct shingles in order, how often each, their weights."""

    def __init__(self, item, h: np.ndarray, width: int):
        self.item, self.size, self.width = item, len(h), width
        g, w = weights(h, width)
        self.shingles, first, self.count = np.unique(g, return_index=True, return_counts=True)
        self.weight = w[first]
        self.total = int(w.sum())

    def probes(self, owners: dict, threshold: float) -> np.ndarray:
        """Of the shingles in the fewest items as many as weigh more than what a match may lack."""
        order = np.argsort([owners[x] for x in self.shingles.tolist()], kind="stable")
        mass = np.cumsum((self.count * self.weight)[order])
        return self.shingles[order[: int(np.searchsorted(mass, (1 - threshold) * self.total + 1e-9, side="right")) + 1]]

    def best(self, g: np.ndarray, running: np.ndarray) -> tuple[float, int, int]:
        """Similarity, first word and words of the best of all windows of a row with the shingles ``g`` and the running sums
        of their weights."""
        n, span = len(g), self.size - self.width + 1
        which = np.minimum(np.searchsorted(self.shingles, g), len(self.shingles) - 1)
        at = np.flatnonzero(self.shingles[which] == g)
        at = at[np.argsort(which[at], kind="stable")]
        which = which[at]
        # An occurrence counts in windows that hold it and fewer than ``count`` equal ones before it.
        full = self.count[which]
        earlier = np.arange(len(at)) - full
        same = (earlier >= 0) & (which[earlier] == which)
        low = np.maximum(np.where(same, at[earlier] + 1, 0), np.maximum(at - span + 1, 0))
        both = np.cumsum(np.bincount(low, self.weight[which], n + 1) - np.bincount(at + 1, self.weight[which], n + 1))[:n]
        own = running[np.minimum(np.arange(n) + span, n)] - running[:n]
        j = both / (self.total + own - both)
        s = int(np.argmax(j))
        return float(j[s]), s, min(self.size, n + self.width - 1 - s)


def similarity(a: np.ndarray, b: np.ndarray, width: int) -> float:
    """Weighted Jaccard of the shingle bags of two word sequences."""
    (ga, wa), (gb, wb) = weights(a, width), weights(b, width)
    left, right = Counter(ga.tolist()), Counter(gb.tolist())
    weight = dict(zip(ga.tolist(), wa.tolist())) | dict(zip(gb.tolist(), wb.tolist()))
    both = sum(min(n, right[g]) * weight[g] for g, n in left.items() if g in right)
    return both / (sum(n * weight[g] for g, n in (left + right).items()) - both) if weight else 0.0


class Index:
    """Fingerprints and block tables of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, width: int):
        self.threshold, self.width, self.lengths = threshold, width, {}
        near = _near()
        for item, text in items:
            data, offsets = arrays.utf8(pa.array([text], pa.string()))
            starts, ends, _ = arrays.words(data, offsets)
            if len(starts):
                h = arrays.hashes(data, starts, ends)
                self.lengths.setdefault(size_class(len(h)), []).append((item, h))
        for m, same in self.lengths.items():
            # One word has no two-word shingle; its own hash stands for it.
            prints = np.array([fingerprint(votes(h[:m], m > 255), m)[0] if m > 1 else h[0] for _, h in same], np.uint64)
            whole = np.array([fingerprint(votes(h, len(h) > 255), len(h))[0] for _, h in same], np.uint64)
            # Items shorter than ``width`` match only windows equal to them: one block, looked up exactly, finds those.
            slots = _slots(prints, 4, near) if m >= width else _slots(prints, 1, near[:1])
            self.lengths[m] = same, prints, whole, slots
        self.longest = max(self.lengths, default=0)
        # Shorter items are one shingle: their matches are equal to them and have their fingerprint.
        self.items = [Item(i, h, width) for same, *_ in self.lengths.values() for i, h in same if len(h) >= width]
        owners = Counter(x for one in self.items for x in one.shingles.tolist())
        held = [one.probes(owners, threshold) for one in self.items]
        probes = np.concatenate([np.zeros(0, np.uint64), *held])
        order = np.argsort(probes, kind="stable")
        self.probes, self.owner_at = np.unique(probes[order], return_index=True)
        self.owner_at = np.append(self.owner_at, len(order))
        self.owners = np.repeat(np.arange(len(held)), [len(x) for x in held])[order]
        self.probed = np.zeros(1 << 22, bool)
        self.probed[self.probes >> np.uint64(42)] = True

    def search(self, h: np.ndarray, first: np.ndarray):
        """(row, item, similarity, first word, words) of the best window of each row and item; ``h`` holds the words of
        all rows, ``first`` where each row begins."""
        best = {}
        wide = self.longest > 255
        for at in range(0, len(h), VOTES):
            total = votes(h[at : at + VOTES + self.longest - 1], wide)
            for m, (same, prints, _, slots) in self.lengths.items():
                if len(total) < m:
                    continue
                found = fingerprint(total, m)[:VOTES] if m > 1 else h[at : at + VOTES].copy()
                for which, item in _candidates(slots, found):
                    far = np.bitwise_count(found[which] ^ prints[item])
                    close = np.flatnonzero(far <= RADIUS)
                    # A candidate that shares several block values is compared once.
                    _, once = np.unique(which[close] * len(same) + item[close], return_index=True)
                    close = close[once]
                    close = close[np.argsort(far[close], kind="stable")]
                    start, item = which[close] + at, item[close]
                    row = np.searchsorted(first, start, side="right") - 1
                    inside = start + m <= first[row + 1]
                    for r, i, s in zip(row[inside].tolist(), item[inside].tolist(), start[inside].tolist()):
                        self._keep(best, r, same[i], h, s, min(len(same[i][1]), int(first[r + 1]) - s))
        count = np.diff(first)
        for m, (same, _, whole, _) in self.lengths.items():
            for r in np.flatnonzero((count < m) & (count >= self.threshold * m - self.width) & (count > 0)):
                own = h[first[r] : first[r + 1]]
                for i in np.flatnonzero(np.bitwise_count(fingerprint(votes(own, len(own) > 255), len(own)) ^ whole) <= RADIUS):
                    self._keep(best, int(r), same[i], h, int(first[r]), len(own))
        self._shared(best, h, first)
        return [(r, item, j, s - int(first[r]), m) for (r, item), (j, s, m) in best.items()]

    def _shared(self, best, h, first):
        """The best window of every row and item of which the row holds a probe."""
        if len(h) < self.width or not len(self.probes):
            return
        g = arrays.windows(h, self.width)
        at = np.flatnonzero(self.probed[g >> np.uint64(42)])
        probe = np.minimum(np.searchsorted(self.probes, g[at]), len(self.probes) - 1)
        row = np.searchsorted(first, at, side="right") - 1
        real = (self.probes[probe] == g[at]) & (at + self.width <= first[row + 1])
        row, probe = np.divmod(np.unique(row[real] * len(self.probes) + probe[real]), len(self.probes))
        for r in np.unique(row).tolist():
            a, b = int(first[r]), int(first[r + 1])
            own, w = weights(h[a:b], self.width)
            running = np.concatenate([[0], np.cumsum(w)])
            mine = probe[np.searchsorted(row, r) : np.searchsorted(row, r, side="right")]
            for i in np.unique(np.concatenate([self.owners[self.owner_at[p] : self.owner_at[p + 1]] for p in mine])).tolist():
                item = self.items[i]
                key = (r, item.item)
                if key in best and best[key][0] >= 1:
                    continue
                j, s, m = item.best(own, running)
                if j >= self.threshold - 1e-12 and (key not in best or (j, -s - a) > (best[key][0], -best[key][1])):
                    best[key] = j, s + a, m

    def _keep(self, best, r, item, h, s, m):
        key = (r, item[0])
        if key in best and best[key][0] >= 1:
            return
        j = similarity(h[s : s + m], item[1], self.width)
        if j >= self.threshold - 1e-12 and (key not in best or (j, -s) > (best[key][0], -best[key][1])):
            best[key] = j, s, m


def _matches(index: Index, column):
    for row, _, data, offsets in arrays.slices(column):
        starts, ends, first = arrays.words(data, offsets)
        for r, *rest in index.search(arrays.hashes(data, starts, ends), first):
            yield row + r, *rest


def indexes(benchmark: DataFrame, item_col: str, text_col: str, threshold: float, width: int):
    """A broadcast index for each block of the benchmark; blocks hold about ``BLOCK`` bytes, whatever its size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    mass = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(mass // BLOCK) + 1
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = sorted(((r.item, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        yield sharing.share(benchmark.sparkSession, Index(rows, threshold, width))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The best window of every document and item of similarity ``threshold`` or more: ``id_col``, ``item_id``,
    ``similarity``, ``first_word`` (from 0), ``n_words``."""
    out = None
    kind = docs.schema[id_col].dataType
    for index in indexes(benchmark, item_col, item_text_col, threshold, width):
        def run(batches, index=index):
            for batch in batches:
                found = list(zip(*_matches(sharing.use(index), batch.column(1)))) or [(), (), (), (), ()]
                yield pa.record_batch([batch.column(0).take(pa.array(found[0], pa.int64())), pa.array(found[1], pa.int64()),
                                       pa.array(found[2], pa.float64()), pa.array(found[3], pa.int64()), pa.array(found[4], pa.int64())],
                                      [id_col, "item_id", "similarity", "first_word", "n_words"])

        part = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
            run, f"`{id_col}` {kind.simpleString()}, item_id long, similarity double, first_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without any match, all columns as they were."""
    for index in indexes(benchmark, item_col, item_text_col, threshold, width):
        def run(batches, index=index):
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                bad[[r for r, *_ in _matches(sharing.use(index), batch.column(text_col))]] = True
                yield batch.filter(pa.array(~bad))
                arrays.give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
