"""LM scoring: a Katz back-off bigram model, counted over the whole corpus and evaluated per token.

Tokens are lower-cased (A-Z) words and one end per text; the first token's context is a start mark. P(w | h) is
d(r) r / c(h) for the r >= ``least`` times (by default all) that w followed h in training texts, else alpha(h) P(w); P(w) is d(c) c / N,
and what discounting leaves goes to unknown words. d is the Good-Turing discount for counts up to ``top``. alpha(h)
makes P(. | h) sum to one exactly; a context whose counts are all undiscounted first gives away one pseudo-count.

The corpus is cut into blocks of some MB of text. A block keeps its texts as numbers of its own words, and its distinct
words and word pairs once each. Counts are asked for in rounds: every block sends its keys with its own counts, dealt by
key into partitioned tables; each part adds up what all blocks sent for a key and returns the totals in the
order asked. So a word or pair costs each block one entry however often it occurs, no group of occurrences is
ever gathered, and the work of a part is bounded by the number of parts, which grows with the corpus. Rounds: words; pairs;
contexts (discounted mass and back-off mass of the kept pairs, each sent by one owner block). Keys are 64-bit hashes.

Null and empty texts have the end token only. Repeated rows and ids count and are scored row by row; a null id counts as
held out or not by the hash of an empty text. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.llm import arrays
from cindergrid.session import cut_lineage, shared_folder

#: Bytes of text in a block.
BLOCK = 5 << 20
END, START = np.uint64(0x5E0F7E37), np.uint64(0x57A27000)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def pack(a: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; small values take few bytes."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(a).to_bytes(5, "little") + a.dtype.str.encode().ljust(4) + pa.compress(raw, "zstd", asbytes=True) if len(a) else b""


def unpack(b: bytes, empty=np.int64) -> np.ndarray:
    if not b:
        return np.zeros(0, empty)
    n, kind = int.from_bytes(b[:5], "little"), np.dtype(b[5:9].decode().strip())
    raw = pa.decompress(b[9:], n * kind.itemsize, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def encode(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Blocks: ids, whether each text trains, texts as numbers of words, and the sorted hashes of the block's words."""

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, end, data, offsets in arrays.slices(batch.column(2), BLOCK):
                data = arrays.LOWER[data]
                starts, ends, first = arrays.words(data, offsets)
                h = np.insert(arrays.hashes(data, starts, ends), first[1:], END)
                words, tokens = np.unique(h, return_inverse=True)
                lengths = np.diff(first) + 1
                yield pa.record_batch([
                    pa.array([task << 32 | at], pa.int64()), pa.array([batch.column(0).slice(row, end - row).to_pylist()], pa.list_(pa.int64())),
                    *(arrays.binary([x]) for x in (
                        pack(1 - np.asarray(batch.column(1).slice(row, end - row), np.uint8)), pack(lengths.astype(np.uint32)),
                        pack(tokens.astype(np.uint32)), pack(words)))], ["block", "ids", "train", "lengths", "tokens", "words"])
                at += 1
                arrays.give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), held.cast("int").alias("held"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "block long, ids array<long>, train binary, lengths binary, tokens binary, words binary")


class Block:
    """The arrays of one block: tokens, who trains, distinct pairs."""

    def __init__(self, row):
        self.ids = row["ids"]
        self.words = unpack(row["words"])
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.trains = unpack(row["train"]).astype(bool)
        self.training = self.trains[self.owner]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training], minlength=len(self.words))

    def pairs(self) -> None:
        """Distinct (context, word): place of the context (the last one is the start), of the word, own count, key."""
        before = np.concatenate([[0], self.tokens[:-1]])
        before[np.cumsum(self.lengths) - self.lengths] = len(self.words)
        own = before * len(self.words) + self.tokens
        order = np.argsort(own, kind="stable")
        new = np.concatenate([[True], own[order[1:]] != own[order[:-1]]])
        which = np.empty(len(own), np.int64)
        which[order] = np.cumsum(new) - 1
        self.pair_of_token, distinct = which, own[order[new]]
        self.left, self.right = np.divmod(distinct, len(self.words))
        self.pair_count = np.bincount(which[self.training], minlength=len(distinct))
        with np.errstate(over="ignore"):
            self.pair_keys = arrays.mix(self.contexts()[self.left] * _PAIR + self.words[self.right])
        self.context_of_token = before

    def contexts(self) -> np.ndarray:
        return np.append(self.words, START)


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending order, and where each part begins: parts are equal ranges of the keys, so neighbours differ little."""
    order = np.argsort(keys, kind="stable")
    part = ((keys[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return order, np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences; the leading bytes of most are zero."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def from_steps(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def questions(block: int, keys: np.ndarray, values: list[np.ndarray], parts: int) -> pa.RecordBatch:
    order, at = dealt(keys, parts)
    keys, values = keys[order], [v[order] for v in values]
    full = [p for p in range(parts) if at[p + 1] > at[p]]
    return pa.record_batch([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()),
                            arrays.binary([steps(keys[at[p] : at[p + 1]]) for p in full]),
                            pa.array([[pack(v[at[p] : at[p + 1]]) for v in values] for p in full], pa.list_(pa.binary()))],
                           ["part", "block", "keys", "values"])


ASKED = "part int, block long, keys binary, values array<binary>"
ANSWERED = "block long, part int, totals array<binary>, owned binary"


def totals(asked: DataFrame, parts: int, finish=None) -> DataFrame:
    """For every question the totals of its keys over all blocks, in its order, and which keys this block is the first to
    name. ``finish`` makes the answers from keys and totals, where they are not the totals themselves. Rows of block -1 have counts of counts: numbers of keys with total 1, 2, ..., then of keys with any, then the sum."""

    def add_up(part, rows):
        keys = [from_steps(k) for _, k, _ in rows]
        sizes = [len(k) for k in keys]
        every, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = [np.bincount(which, np.concatenate([unpack(v[j]) for _, _, v in rows]), len(every)) for j in range(len(rows[0][2]))]
        owns = np.zeros(len(which), np.uint8)
        owns[first] = 1
        blocks, out, owned, at = [], [], [], 0
        answers = sums if finish is None else finish(every, sums)
        whole = [s.astype(np.int64) if np.all(s == np.rint(s)) else s for s in answers]
        for (block, _, _), n in zip(rows, sizes):
            blocks.append(block)
            out.append([pack(s[which[at : at + n]]) for s in whole])
            owned.append(pack(owns[at : at + n]))
            at += n
        count = np.rint(sums[0]).astype(np.int64)
        of = np.bincount(count[count < 32], minlength=32)[1:]
        stats = np.concatenate([of, [(count > 0).sum(), count.sum()]])
        return pa.record_batch([pa.array([*blocks, -1], pa.int64()), pa.array([part] * (len(blocks) + 1), pa.int32()),
                                pa.array([*out, [pack(stats)]], pa.list_(pa.binary())), arrays.binary([*owned, b""])],
                               ["block", "part", "totals", "owned"])

    def run(batches):
        held, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != held and rows:
                    yield add_up(held, rows)
                    rows = []
                    arrays.give_back()
                held = row["part"]
                rows.append((row["block"], row["keys"], row["values"]))
        if rows:
            yield add_up(held, rows)
        arrays.give_back()

    return asked.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(run, ANSWERED)


def aligned(answers, keys: np.ndarray, parts: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Totals and ownership in the order of ``keys``."""
    order, _ = dealt(keys, parts)
    answers = sorted(answers, key=lambda a: a["part"])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    n = len(answers[0]["totals"])
    return [np.concatenate([unpack(a["totals"][j]) for a in answers])[back] for j in range(n)], np.concatenate([unpack(a["owned"]) for a in answers])[back]


def discounts(counts: np.ndarray, top: int) -> np.ndarray:
    """Good-Turing discount of counts 0 .. top + 1 (1 above ``top``); absolute discounting where counts of counts don't
    allow it."""
    n = np.concatenate([[0], counts[: top + 2]]).astype(float)
    d = np.ones(top + 2)
    tail = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    flat = min(max(flat, 0.05), 0.95)
    for r in range(1, top + 1):
        gt = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        d[r] = gt if 0 < gt < 1 else (r - flat) / r
    return d


def _stats(answers: DataFrame) -> np.ndarray:
    """Counts of counts, added up over all parts; one short row a part."""
    rows = answers.where("block = -1").select("totals").toArrow().column(0).to_pylist()
    return sum((unpack(r[0]) for r in rows), np.zeros(33, np.int64))


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", least: int = 1, top: int = 5) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (additive unigrams, the yardstick) and score,
    the model's log10 probability of the text. Rows with ``held`` don't train."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"katz_{uuid.uuid4().hex}"
    # Bucketed by block: the rounds below send answers to the blocks, and never move the blocks.
    encode(docs, id_col, text_col, held).write.bucketBy(parts, "block").option("path", shared_folder(spark)).saveAsTable(name)
    blocks = spark.table(name)
    size = blocks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    parts = max(parts, int(size >> 21))

    def known(*rounds):
        out = blocks
        for i, r in enumerate(rounds):
            per = r.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "totals", "owned")).alias(f"round{i}"))
            out = out.join(per.hint("shuffle_hash"), "block")
        return out

    def ask_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                yield questions(row["block"], b.words, [b.word_counts()], parts)

    words = cut_lineage(totals(blocks.mapInArrow(ask_words, ASKED), parts))
    stats = _stats(words)
    total, distinct = int(stats[-1]), int(stats[-2])
    d1 = discounts(stats[:31], top)

    def chances(c):
        return d1[np.minimum(c, top + 1)] * c / max(total, 1)

    low = np.arange(1, top + 1)
    unknown = max(float((stats[:top] * low * (1 - d1[1 : top + 1])).sum()) / max(total, 1), 1e-12) if total else 1.0

    def ask_pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                b.pairs()
                yield questions(row["block"], b.pair_keys, [b.pair_count], parts)
                arrays.give_back()

    pairs = cut_lineage(totals(blocks.mapInArrow(ask_pairs, ASKED), parts))
    d2 = discounts(_stats(pairs)[:31], top)

    def counted(row):
        b = Block(row)
        b.pairs()
        (c,), b.first = aligned(row["round0"], b.words, parts)
        b.c = c.astype(np.int64)
        (r,), b.owns = aligned(row["round1"], b.pair_keys, parts)
        b.r = r.astype(np.int64)
        b.kept = b.r >= least
        b.mass = d2[np.minimum(b.r, top + 1)] * b.r
        return b

    def ask_contexts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = counted(row)
                mine = b.kept & (b.owns > 0)
                n = len(b.words) + 1
                send = [np.bincount(b.left[mine], v[mine], n) for v in (b.mass, chances(b.c[b.right]))]
                # One block names each context's count; the start's is the number of training texts.
                send.append(np.append(np.where(b.first > 0, b.c, 0), b.trains.sum()).astype(float))
                yield questions(row["block"], b.contexts(), send, parts)
                arrays.give_back()

    def back_off(keys, sums):
        """Weight of the lower order, and whether the context gives away a pseudo-count."""
        mass, lower, c = sums
        more = (mass > 0) & (c - mass < 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            return [np.where(mass > 0, (1 - mass / (c + more)) / (1 - lower), 1.0), more.astype(float)]

    contexts = cut_lineage(totals(known(words, pairs).mapInArrow(ask_contexts, ASKED), parts, back_off))

    def evaluate(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = counted(row)
                alpha, more = aligned(row["round2"], b.contexts(), parts)[0]
                # A text's end occurs once a text, as its start does.
                c = np.append(b.c, b.c[np.searchsorted(b.words, END)]) + more
                with np.errstate(divide="ignore", invalid="ignore"):
                    seen = b.mass / c[b.left]
                word = np.where(b.c > 0, chances(b.c), unknown)
                pair = np.log10(np.where(b.kept, seen, alpha[b.left] * word[b.right]))
                base = np.log10((b.c + 0.5) / (total + 0.5 * (distinct + 1)))
                n = len(b.lengths)
                yield pa.record_batch([
                    pa.array(b.ids, pa.int64()), pa.array(~b.trains), pa.array(b.lengths, pa.int64()),
                    pa.array(np.bincount(b.owner, b.c[b.tokens] > 0, n).astype(np.int64)), pa.array(np.full(n, total), pa.int64()),
                    pa.array(np.bincount(b.owner, base[b.tokens], n)), pa.array(np.bincount(b.owner, pair[b.pair_of_token], n))],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                arrays.give_back()

    out = cut_lineage(known(words, pairs, contexts).mapInArrow(
        evaluate, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    spark.sql(f"DROP TABLE {name}")
    return out
