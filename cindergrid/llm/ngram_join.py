"""N-gram Jaccard join: MinHash LSH forest, shortened prefixes, exact verification.

A text's set holds the hashes of its ``width``-word shingles (of all its words where it has fewer; texts without words
have an empty set, resemble nothing and are classes and groups of their own). Equal sets collapse to one class first,
so copies are never compared. Each class gets ``trees`` MinHash labels of ``deepest`` components. Classes that share
the shortest allowed prefix of a label in some tree form the tries; all others are done. Within the tries, matched
prefixes start at the full length and are shortened one component at a time until the chance to be found reaches
``target`` in every hundredth of similarity that holds verified links.

Verification is exact on whole sets and runs in blocks: each class has a home, the largest bucket it is in, cut into
blocks of bounded volume and number; two blocks are compared when they share a bucket. Links leave a block pair as one count
per class and a spanning forest, never as pairs, so a group of thousands of near copies costs no quadratic output.

Null ids keep their class but can't stand for it; repeated rows count as copies; ties go to the smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cindergrid.llm import arrays
from cindergrid.session import cut_lineage

#: Rows of a task, where the rows of a table are known. The driver keeps an account of every task, so small tables aren't dealt
#: over as many tasks as the session has shuffle partitions.
PIECE = 200_000

_random = np.random.Generator(np.random.PCG64(8111))


def _minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of each permutation's minimum over the set."""
    low = np.full(len(a), 2**32 - 1, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[None, at : at + 2048] * a[:, None] + b[:, None]).min(1), out=low)
    return (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _sets(column, width):
    """Row number and sorted distinct shingle hashes of each row."""
    for row, _, data, offsets in arrays.slices(column):
        starts, ends, first = arrays.words(data, offsets)
        h = arrays.hashes(data, starts, ends)
        for i in range(len(offsets) - 1):
            yield row + i, arrays.distinct(arrays.windows(h[first[i] : first[i + 1]], width))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int, deepest: int) -> DataFrame:
    """Per row: id, set size n, digest of the set (null if empty) and all labels as bytes."""

    def run(batches):
        random = np.random.Generator(np.random.PCG64(77))
        a = random.integers(0, 2**32, trees * deepest, dtype=np.uint32) | np.uint32(1)
        b = random.integers(0, 2**32, trees * deepest, dtype=np.uint32)
        for batch in batches:
            n, digest, label = [], [], []
            for _, s in _sets(batch.column(1), width):
                n.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                label.append(_minhash(s, a, b).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), arrays.binary(digest), arrays.binary(label)],
                                  ["id", "n", "digest", "label"])
            arrays.give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, digest binary, label binary")


def chance(similarity: np.ndarray | float, trees: int, depth: int):
    """The chance that two sets of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def _links(a, b, threshold, same):
    """Index pairs and similarities of sets in blocks a and b (lists of sorted arrays) that reach the threshold."""
    every = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in [*a, *b]])
    values, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    owner, column = owner[column >= 0], column[column >= 0]
    common = np.zeros((len(a), len(b)), np.float32)
    # Columns of the dense matrix are as many as fit 64 MB, whatever the number of sets.
    wide = max(1, min(16384, (1 << 24) // (len(a) + len(b))))
    for at in range(0, int(shared.sum()), wide):
        part = (column >= at) & (column < at + wide)
        m = np.zeros((len(a) + len(b), wide), np.float32)
        m[owner[part], column[part] - at] = 1
        common += m[: len(a)] @ m[len(a):].T
    sizes = np.array([len(s) for s in a], float)[:, None] + np.array([len(s) for s in b], float)[None, :]
    common = common.astype(float)
    j = common / (sizes - common)
    hit = common >= threshold * (sizes - common) - 1e-9
    if same:
        hit &= np.triu(np.ones_like(hit), 1)
    x, y = np.nonzero(hit)
    return x, y, j[x, y]


def _root(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows of kind 0: class a has n linked documents more; 1: a and b are linked; 2: n links fell in similarity bin a."""

    def run(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                left, right = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                same = right is None
                right = left if same else right
                x, y, j = _links(*([np.frombuffer(m["set"], np.uint64) for m in side] for side in (left, right)), threshold, same)
                if not len(x):
                    continue
                ids = [m["class"] for m in left] + ([] if same else [m["class"] for m in right])
                y = y + (0 if same else len(left))
                copies = np.array([m["copies"] for m in left] + ([] if same else [m["copies"] for m in right]), float)
                links = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
                parent = list(range(len(ids)))
                for p, q in zip(x.tolist(), y.tolist()):
                    p, q = _root(parent, p), _root(parent, q)
                    parent[max(p, q)] = min(p, q)
                out += [(0, ids[i], 0, int(links[i])) for i in np.flatnonzero(links)]
                out += [(1, ids[i], ids[r], 0) for i in range(len(ids)) if (r := _root(parent, i)) != i]
                bins = np.bincount(np.minimum((j * 100).astype(int), 100), minlength=101)
                out += [(2, int(i), 0, int(bins[i])) for i in np.flatnonzero(bins)]
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                  ["kind", "a", "b", "n"])
            arrays.give_back()

    return pairs.mapInArrow(run, "kind int, a long, b long, n long")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most about ``rows`` rows, in no more tasks than these need; large tables stay as they are."""
    most = rows // PIECE + 1
    return df.coalesce(most) if most < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame) -> DataFrame:
    """Smallest member ``root`` of each node ``v`` of the undirected edges (a, b); alternating large and small stars.

    Every step is a grouped minimum and an equi-join; a node's neighbours are never gathered. The edge set is written
    after each round and has converged when a round leaves it as it was."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        before, n = state, state[0]  # the rows of a round are no more than twice the edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _few(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), n)
        large = _few(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), n)
        edges = cut_lineage(_few(large.distinct(), n))
        low = _few(edges.groupBy("a").agg(F.min("b").alias("m")), n)
        linked = edges.join(low, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = cut_lineage(_few(_few(small, 2 * n).distinct(), n))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5,
               trees: int = 32, deepest: int = 8, shortest: int = 6, target: float = 0.9995, volume: int = 1 << 17, most: int = 2048) -> DataFrame:
    """One row per input row: ``id_col``, ``class_id`` (smallest id with the same set; null for empty sets),
    ``group_id`` (smallest id connected by links), ``n_links`` (other rows of similarity ``threshold`` or more).

    ``volume`` bounds the shingles and ``most`` the sets of a block, both on average. Empty tables give no rows."""
    spark = docs.sparkSession
    signed = cut_lineage(sign(docs, id_col, text_col, width, trees, deepest))
    classes = cut_lineage(signed.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("class"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("label").alias("label")
    ).where("class is not null"))

    def prefix(depth):
        return F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * depth})"))

    leaves = classes.select("class", "n", F.posexplode(F.expr(
        f"transform(sequence(0, {trees - 1}), t -> substring(label, t * {2 * deepest} + 1, {2 * deepest}))")).alias("tree", "label"))
    rooted = leaves.withColumn("bucket", prefix(shortest))
    full = rooted.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("mass")).where("members > 1")
    tries = cut_lineage(rooted.join(full, "bucket"))

    home = tries.groupBy("class").agg(F.max(F.struct("members", "bucket", "mass", "n")).alias("home"))
    block = F.xxhash64("home.bucket", F.expr(f"pmod(xxhash64(class), cast(ceil(greatest(home.mass / {volume}, home.members / {most})) as bigint))"))
    home = cut_lineage(home.select("class", block.alias("block")))
    entries = tries.count()
    member = home.join(classes.select("class", "copies", "digest"), "class")

    def gather(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2),
                                   arrays.binary([s.tobytes() for _, s in _sets(batch.column(3), width)])],
                                  ["block", "class", "copies", "set"])
            arrays.give_back()

    texts = docs.select(F.col(id_col).cast("long").alias("class"), F.col(text_col).alias("text")).join(member, "class") \
        .dropDuplicates(["class"]).select("block", "class", "copies", "text")
    blocks = cut_lineage(texts.mapInArrow(gather, "block long, class long, copies long, set binary").groupBy("block").agg(
        F.collect_list(F.struct("class", "copies", "set")).alias("members")))

    rows = tries.select("class", "tree", "label").join(home, "class")
    done, found = None, []
    for depth in range(deepest, shortest - 1, -1):
        placed = _few(_few(rows, entries).select(prefix(depth).alias("bucket"), "block").distinct(), entries)
        met = placed.join(placed.withColumnRenamed("block", "other"), "bucket").where("block < other").select("block", "other").distinct()
        if depth == deepest:
            met = met.unionByName(home.select("block", F.col("block").alias("other")).distinct())
        if done is not None:
            met = met.join(done, ["block", "other"], "left_anti")
        met = cut_lineage(met)
        done = met if done is None else done.unionByName(met)
        inside = met.where("block = other").join(blocks, "block").select(
            F.col("members").alias("left"), F.lit(None).cast(blocks.schema["members"].dataType).alias("right"))
        across = met.where("block <> other").join(blocks, "block").withColumnRenamed("members", "left").join(
            blocks.select(F.col("block").alias("other"), F.col("members").alias("right")), "other").select("left", "right")
        found.append(cut_lineage(_verify(inside.unionByName(across), threshold)))
        seen = spark.createDataFrame([], found[0].schema)
        for part in found:
            seen = seen.unionByName(part)
        bins = seen.where("kind = 2").groupBy("a").agg(F.sum("n")).collect()  # at most 101 rows
        # Many links of high similarity in one hot group must not end the search for those near the threshold elsewhere.
        if bins and all(chance(max(threshold, b / 100), trees, depth) >= target for b, _ in bins):
            break

    roots = components(seen.where("kind = 1").select("a", "b"))
    links = seen.where("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    known = classes.select("class", "copies", "digest").join(links, "class", "left").join(
        roots.select(F.col("v").alias("class"), "root"), "class", "left").where("copies > 1 or links > 0")
    out = signed.select("id", "digest").join(known, "digest", "left")
    return out.select(F.col("id").alias(id_col),
                      F.when(F.col("digest").isNotNull(), F.coalesce("class", "id")).alias("class_id"),
                      F.coalesce("root", "class", "id").alias("group_id"),
                      F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, one row per id, all columns as they were.

    Rows without id stay. The ids to drop are joined with the texts."""
    found = cut_lineage(ngram_join(docs, id_col, text_col, **options).select(F.col(id_col).cast("long").alias("ngram_id"), "group_id"))
    drop = found.where("ngram_id <> group_id").select("ngram_id").distinct()
    again = found.where("ngram_id is not null").groupBy("ngram_id").count().where("count > 1").select("ngram_id")
    # The ids to drop grow with the corpus, so the plan doesn't count on their being few.
    kept = docs.join(drop.hint("merge"), F.col(id_col) == F.col("ngram_id"), "left_anti")
    again = cut_lineage(again.join(drop, "ngram_id", "left_anti"))
    if again.isEmpty():
        return kept
    once = kept.join(again, F.col(id_col) == F.col("ngram_id"), "left_semi").dropDuplicates([id_col])
    return kept.join(again, F.col(id_col) == F.col("ngram_id"), "left_anti").unionByName(once)
