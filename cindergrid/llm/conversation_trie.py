"""Prefix trie of conversations: every distinct opening is a node; totals roll up by bands of depths.

A conversation is its turns (role, text) in order; null roles and texts are empty, rows without conversation id are left
out, rows of one conversation that share a turn number are ordered by role and text, repeated rows are turns of their own.
An empty table has no nodes, not even the root. Turn columns are read by name; columns of other names play no part.

A node's key is a digest of depth and running sums: each turn adds four 32-bit parts of a digest of its place, role and
text, so openings are equal when all sums are. Sums need no order between blocks of a conversation, so a conversation
of any length is numbered and summed in blocks of ``BLOCK`` turns, each shifted by the blocks before it.

Totals of subtrees: a band holds ``height`` depths. Nodes explode only to their ancestors within their band, found along
the path of their smallest member. The tops of bands form a trie of a ``height``-th of the depth, whose completed totals
come from the same roll-up; then each top adds its total to the nodes between itself and the top above. So a node explodes to at
most ``height`` rows a level, and the rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cindergrid.session import cut_lineage

#: Turns of one conversation that a window holds at once.
BLOCK = 1024
#: Ids that travel as one piece of a node's list.
PIECE = 1 << 16
PARTS = ["s0", "s1", "s2", "s3"]


def _shifted(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Running sums of ``sums`` within conversation ``c``, from blocks ``block`` and the totals of the blocks before."""
    here = Window.partitionBy("c", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy("c", "block").agg(*[F.sum(s).alias(f"in_{s}") for s in sums]).select(
        "c", "block", *[F.coalesce(F.sum(f"in_{s}").over(ahead), F.lit(0)).alias(f"in_{s}") for s in sums])
    run = df.withColumns({f"run_{s}": F.sum(s).over(here) for s in sums}).join(before, ["c", "block"])
    return run.withColumns({f"run_{s}": F.col(f"run_{s}") + F.col(f"in_{s}") for s in sums}).drop(*[f"in_{s}" for s in sums])


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c, pos, mark, size``: place from 1, digest of role and text, UTF-8 bytes of the text. Texts end here."""
    role, text = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.where("c is not null").withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**63)))).withColumn("one", F.lit(1).cast("long"))
    placed = _shifted(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["one"])
    mark = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32))
    return placed.select("c", F.col("run_one").alias("pos"), mark.alias("mark"), F.octet_length("text").cast("long").alias("size"))


def grafted(places: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared openings: ``c, pos, mark, size`` and all conversations ``c, length``.

    Conversation c takes the first h turns of conversation c - c % every (all it has; none if there is none) and its own
    turns after its first h, where h is the CRC-32 of the decimal id modulo ``most``. Remainders have the sign of c."""
    lengths = cut_lineage(places.groupBy("c").agg(F.count("*").alias("own")))
    short = lengths.select(F.col("c").alias("base"), F.least(F.col("own"), F.lit(most)).alias("has"))
    plan = lengths.withColumns({"h": F.crc32(F.col("c").cast("string")) % most, "base": F.col("c") - F.col("c") % every}).join(short, "base", "left")
    plan = cut_lineage(plan.select("c", "base", "h", "own", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")))
    heads = places.where(F.col("pos") < most).select(F.col("c").alias("base"), "pos", "mark", "size").join(plan.select("c", "base", "h"), "base")
    tails = places.join(plan.select("c", "h", "taken"), "c").where("pos > h")
    turns = heads.where("pos <= h").select("c", "pos", "mark", "size").unionByName(
        tails.select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "mark", "size"))
    return turns, plan.select("c", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def paths(places: DataFrame, convs: DataFrame) -> DataFrame:
    """``c, pos, key, up, size``: the node of every opening of every conversation, the textless one (pos 0) included."""
    digest = F.md5(F.concat(F.col("pos").cast("string").cast("binary"), F.col("mark")))
    parts = {s: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i, s in enumerate(PARTS)}
    start = convs.select("c", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("size"), *[F.lit(0).cast("long").alias(s) for s in PARTS])
    rows = places.withColumns(parts).select("c", "pos", "size", *PARTS).unionByName(start).withColumn("block", F.floor(F.col("pos") / BLOCK))
    run = _shifted(rows, [F.col("pos")], PARTS)

    def key(pos: Column, sums: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", pos.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))

    here = [F.col(f"run_{s}") for s in PARTS]
    above = F.when(F.col("pos") > 0, key(F.col("pos") - 1, [r - F.col(s) for r, s in zip(here, PARTS)]))
    return run.select("c", "pos", key(F.col("pos"), here).alias("key"), above.alias("up"), "size")


def subtree_sums(nodes: DataFrame, path: DataFrame, values: list[str], height: int) -> DataFrame:
    """``key`` and each of ``values`` summed over the node and all below it.

    ``nodes``: key, c (a member), depth, values; ``path``: c, pos, key of all openings of the members named."""
    if height < 2:
        raise ValueError("a band holds two depths at least")

    def added(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])

    def band(x: str) -> Column:
        return F.floor(F.col(x) / height)

    steps = path.select("c", band("pos").alias("band"), "pos", "key")
    own = nodes.select("c", band("depth").alias("band"), "depth", *values)
    inside = cut_lineage(added(own.join(steps, ["c", "band"]).where("pos <= depth"), "key", "pos"))
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < height:
        return inside.select("key", *values)
    tops = nodes.where(F.col("depth") % height == 0).select("key", "c", band("depth").alias("depth"))
    above = path.where(F.col("pos") % height == 0).select("c", band("pos").alias("pos"), "key")
    whole = cut_lineage(subtree_sums(tops.join(inside.drop("pos"), "key"), above, values, height))
    over = tops.where("depth > 0").join(whole, "key").select("c", (F.col("depth") - 1).alias("band"), *values)
    between = added(over.join(steps.where(F.col("pos") % height > 0), ["c", "band"]), "key")
    rest = inside.where(F.col("pos") % height > 0).select("key", *values).unionByName(between)
    return whole.select("key", *values).unionByName(added(rest, "key"))


def digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of the decimal ids ``c`` of each ``key``, ascending, comma-joined.

    Ids are sorted over all tasks and joined to pieces of at most ``PIECE``; a node's pieces then run through one
    digest in order, so that no list is ever held whole."""

    def join(batches):
        key, first, ids = None, None, []
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or len(ids) == PIECE:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids = k, c, []
                ids.append(str(c))
            yield pieces(out)
        if ids:
            yield pieces([(key, first, ",".join(ids))])

    def pieces(rows):
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["key", "first", "ids"])

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield done(out)
        if state is not None:
            yield done([(key, state.hexdigest())])

    def done(rows):
        return pa.record_batch([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], ["key", "ends_sha256"])

    joined = ends.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(join, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(places: DataFrame, convs: DataFrame, height: int = 8) -> DataFrame:
    """One row per node: ``key, conv_id`` (smallest member), ``depth, parent_conv_id, n_convs`` (members), ``n_children,
    n_leaves`` and ``saved_tokens`` (over the subtree), ``ends_sha256`` (of the members that end here).

    ``places``: c, pos, mark, size as :func:`numbered` gives them; ``convs``: c, length of every conversation, those
    without turns included."""
    path = cut_lineage(paths(places, convs))
    nodes = cut_lineage(path.groupBy("key").agg(F.min("c").alias("c"), F.count("*").alias("n_convs"), F.first("pos").alias("depth"),
                                                F.first("up").alias("up"), F.first("size").alias("size")))
    children = nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    counted = cut_lineage(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    worth = counted.select("key", "c", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    totals = subtree_sums(worth, path.select("c", "pos", "key"), ["n_leaves", "saved_tokens"], height)
    ends = digests(path.join(convs, "c").where("pos = length"))
    parents = nodes.select(F.col("key").alias("up"), F.col("c").alias("parent_conv_id"))
    return counted.join(totals, "key").join(ends, "key", "left").join(parents, "up", "left").select(
        "key", F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def lengths(places: DataFrame) -> DataFrame:
    """``c, length`` of the conversations that have turns."""
    return places.groupBy("c").agg(F.max("pos").alias("length"))
