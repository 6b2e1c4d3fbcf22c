"""SimHash near duplicates by deletion variants: fewer segments than bits to miss, each looked up with one bit left out.

A text's fingerprint has 64 bits: each is set where more than half the XXH64 digests of its shingles have it. Shingles are
``width`` words, repeats included, A-Z lower-cased, joined by one space; a shorter text is one shingle. Texts without words and
null texts have fingerprint zero and are linked like any other. Fingerprints link at ``RADIUS`` or fewer differing bits.

Of two halves of a fingerprint, one differs by at most one bit where the whole differs by three. So every distinct fingerprint
is filed 64 times: under each half with each of its bits left out in turn. Keys with two members give one pair, checked in place;
longer ones up to ``LIMIT`` are gathered and leave a spanning forest of their links. Above that a key isn't gathered but cut again: of the
half that was not in the key, again one half differs by at most one bit, and once more in the rest. What is then left free is 11 bits, so that
no key of the third level can hold more than 2,048 distinct fingerprints. No key is capped and no link is lost.

Copies meet as one fingerprint before anything is compared. Rows without id get their group's smallest id (null where it has
none) and never name one; repeated rows are kept; columns of other names play no part; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.llm import arrays
from cindergrid.llm.ngram_join import components
from cindergrid.session import cut_lineage

RADIUS = 3
#: Distinct fingerprints of one key that are compared in one task; keys of the last level can't hold more.
LIMIT = 2048
#: Shingles of one text whose bits are counted at once.
PIECE = 1 << 15


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[width - 1 :] or ends[-1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), PIECE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(ends), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp`` of every row."""

    def run(batches):
        for batch in batches:
            fps = []
            for _, end, data, offsets in arrays.slices(batch.column(1)):
                raw = data.tobytes()
                fps += [fingerprint(raw[a:b], width) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])
            arrays.give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, fp long")


def variants(base: Column, half: int) -> Column:
    """Keys of the two ``half``-bit parts of ``fp`` from bit ``base`` on, each with one bit left out: part, bit and value in one number."""
    return F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), lambda v: F.shiftleft(v.cast("long"), half).bitwiseOR(
        F.call_function("shiftrightunsigned", F.col("fp"), (base + F.floor(v / half) * half).cast("int"))
        .bitwiseAND(F.lit((1 << half) - 1)).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), (v % half).cast("int"))))))


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what fingerprints within the radius connect: each is visited once and compared with those not yet reached."""
    bits, left, links = fps.view(np.uint64), np.arange(len(fps)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= RADIUS
            links += [(int(fps[at]), int(fps[i])) for i in left[near]]
            reached += left[near].tolist()
            left = left[~near]
    return links


def _gathered(members: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            column = batch.column(0)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            links = [x for a, b in zip(offsets, offsets[1:]) for x in _forest(values[a:b])]
            a, b = zip(*links) if links else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that connect all that the radius connects."""
    keys, rows, base, half, found = [], fps.select("fp"), F.lit(0), 32, []
    while half >= 8:
        key = f"key{half}"
        filed = rows.select(*keys, "fp", F.explode(variants(base, half)).alias(key))
        keys = [*keys, key]
        counted = cut_lineage(filed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        found.append(counted.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b"))
        last = half == 8
        middle = counted.where("n > 2") if last else counted.where(F.col("n").between(3, limit))
        found.append(_gathered(filed.join(middle.select(*keys).hint("merge"), keys).groupBy(*keys).agg(F.collect_list("fp").alias("fps")).select("fps")))
        hot = cut_lineage(counted.where(F.col("n") > limit).select(*keys))
        if last or hot.isEmpty():
            break
        rows = cut_lineage(filed.join(hot, keys))
        # The part that isn't in the key is cut next.
        base = base + (1 - F.floor(F.shiftright(F.col(key), half) / half)) * half
        half //= 2
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links)."""
    signed = cut_lineage(fingerprints(docs, id_col, text_col, width))
    fps = cut_lineage(signed.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    roots = components(links(fps, limit)).withColumnRenamed("v", "fp")
    roots = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = cut_lineage(fps.select("fp", "first").join(roots, "fp"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    known = linked.join(lowest, "root").select("fp", "lowest").unionByName(
        fps.where("copies > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("lowest")))
    known = cut_lineage(known.withColumn("grouped", F.lit(True)))
    return signed.join(known.hint("merge"), "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("grouped"), F.col("lowest")).otherwise(F.col("id")).alias("component_id"))
