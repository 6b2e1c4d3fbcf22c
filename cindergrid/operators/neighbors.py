"""Exact nearest neighbours without comparing all pairs.

Base rows are assigned to the nearest of a few pivots. A query only visits the pivot cells that can
hold one of its ``k`` nearest rows, judged by the triangle inequality, so the answer is exact. Large
cells are cut into blocks of a fixed number of rows and large groups of visiting queries into chunks, so
no task holds more than one block and one chunk, whatever the skew; each returns only ``k`` rows per
query. Copies of one vector are reduced to the ``k`` that can matter before anything moves.

Where a sample of the queries shows that pruning leaves most cells, as in many dimensions, all pairs of packed blocks are
compared instead: a task holds a few blocks of queries and passes over the blocks of base rows, which it reads from the shared
folder; each query's vector is shuffled once, and what leaves a task is ``k`` rows per query.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from cindergrid.session import cut_lineage

# Send this module's functions to the Python workers themselves, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096
#: Queries and base rows compared at once, and pairs measured at once.
ROWS, COLUMNS, MEASURED = 512, 1024, 1 << 15
#: Blocks of queries a task holds.
HELD = 4
#: No row's number.
NONE = np.iinfo(np.int64).max
MAX_PIVOTS = 1024
#: Queries on which pruning is judged, and the share of rows visited above which all blocks are compared.
JUDGED = 1024
DENSE = 0.25
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in vectors])


def _pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(v), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((v - p) ** 2).sum(axis=1))
    return out


class Best:
    """The ``k`` nearest rows of some queries among the rows seen so far, by exact squared distance, then number.

    Inner products in single precision, with a bound of their error, leave out rows that are farther than the ``k`` found; the
    others are measured exactly."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.d2, self.ids = np.full((len(q), k), np.inf), np.full((len(q), k), NONE)
        plain = np.isfinite((q**2).sum(axis=1))
        self.odd = np.flatnonzero(~plain)
        self.centre = q[plain].mean(axis=0) if plain.any() else np.zeros(q.shape[1])
        self.moved = np.where(plain[:, None], q, self.centre) - self.centre
        self.square = (self.moved**2).sum(axis=1)
        self.size, self.shift = np.sqrt(self.square), np.sqrt((self.centre**2).sum())
        self.square[self.odd] = np.nan  # these are measured with every row
        self.left = {}

    def add(self, b: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(b), COLUMNS):
            self._add(b[at : at + COLUMNS], ids[at : at + COLUMNS])

    def _add(self, b: np.ndarray, ids: np.ndarray) -> None:
        everyone = np.arange(len(self.q))
        plain = np.isfinite((b**2).sum(axis=1))
        if not plain.all():
            odd = np.flatnonzero(~plain)
            self._measure(np.repeat(everyone, len(odd)), np.tile(odd, len(everyone)), b, ids)
        if len(self.odd):
            self._measure(np.repeat(self.odd, plain.sum()), np.tile(np.flatnonzero(plain), len(self.odd)), b, ids)
        b, ids = b[plain], ids[plain]
        if not len(b):
            return
        c = b - self.centre
        half = (c * c).sum(axis=1) / 2
        size = math.sqrt(2 * half.max())
        largest = max(size, self.size.max())
        kind = np.float32 if 1e-12 < largest < 1e15 else np.float64
        if kind not in self.left:
            self.left[kind] = np.column_stack([self.moved, np.ones(len(self.q))]).astype(kind)
        left, right = self.left[kind], np.column_stack([c, -half]).astype(kind).T
        # Bounds of the rounding of sums and factors, of numbers too small for the kind, and of moving to the centre.
        slack = (4 * (b.shape[1] + 8) * np.finfo(kind).eps * (self.size * size + half.max())
                 + b.shape[1] * float(np.finfo(kind).tiny) * 16 * (1 + self.size + size) + 2.0**-48 * (self.shift + largest) * (self.size + size))
        for at in range(0, len(left), ROWS):
            rows = slice(at, at + ROWS)
            near = left[rows] @ right  # rises as the distance falls
            least = (self.square[rows] - self.d2[rows, -1]) / 2 - slack[rows]
            some = np.flatnonzero(near.max(axis=1) >= least.astype(kind))
            if len(some) < len(near):
                near, least = near[some], least[some]
            r, i = np.nonzero(near >= least.astype(kind)[:, None])
            if len(r) > 8 * self.k * len(near) and len(b) > self.k:  # little is known yet
                least = np.maximum(least, np.partition(near, len(b) - self.k, axis=1)[:, len(b) - self.k] - 2 * slack[rows][some])
                r, i = np.nonzero(near >= least.astype(kind)[:, None])
            self._measure(some[r] + at, i, b, ids)

    def _measure(self, r: np.ndarray, c: np.ndarray, b: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(r), MEASURED):
            rr, cc = r[at : at + MEASURED], c[at : at + MEASURED]
            d = ((self.q[rr] - b[cc]) ** 2).sum(axis=1)
            kept = d <= self.d2[rr, -1]  # nan is no distance
            rr, cc, d = rr[kept], cc[kept], d[kept]
            changed = np.unique(rr)
            rr = np.concatenate([np.repeat(changed, self.k), rr])
            d, i = np.concatenate([self.d2[changed].ravel(), d]), np.concatenate([self.ids[changed].ravel(), ids[cc]])
            order = np.lexsort((i, d, rr))
            rr = rr[order]
            order = order[np.arange(len(rr)) - np.searchsorted(rr, rr) < self.k]
            self.d2[changed], self.ids[changed] = d[order].reshape(-1, self.k), i[order].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, numbers and squared distances."""
        rows, places = np.nonzero(self.ids != NONE)
        return rows, self.ids[rows, places], self.d2[rows, places]


def _nearest_in_block(q: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int):
    """Rows, base positions and exact squared distances of the k nearest base rows per query."""
    best, order = Best(q, k), np.argsort(ids, kind="stable")
    best.add(b, ids)
    rows, found, d2 = best.found()
    return rows, order[np.searchsorted(ids[order], found)], d2


def prepared(queries: DataFrame, base: DataFrame, k: int, id: str, vector: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries ``id, v``; base rows ``id, v`` without copies that can't be among the ``k`` nearest; distinct vectors asked
    for as ``q, v``. The last two are written, because they are read several times."""
    known = F.col("id").isNotNull() & F.col("v").isNotNull()
    queries, points = (df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(known)
                       for df in (queries, base))
    points = (points.withColumn("_copy", F.row_number().over(Window.partitionBy("v").orderBy("id")))
              .filter(F.col("_copy") <= k).drop("_copy"))
    return queries, cut_lineage(points), cut_lineage(queries.groupBy("v").agg(F.min("id").alias("q")))


def give_back(queries: DataFrame, asked: DataFrame, best: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The result of the search for each distinct vector, ``q, neighbour_id, d2, rank``, for every query with that vector."""
    owners = queries.join(asked, "v").select("q", F.col("id").alias("query_id"))
    out = owners.join(best, "q").select("query_id", "neighbour_id", F.sqrt("d2").alias("distance"), "rank")
    if exclude_self:
        out = out.filter("query_id <> neighbour_id")
        mine = Window.partitionBy("query_id").orderBy("rank")
        out = out.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank").cast("int"))


def _packed(df: DataFrame, id: str, block: int) -> DataFrame:
    """``block, ids, v``: up to ``block`` rows in a row, as the bytes of their numbers."""
    def record(ids, v):
        return pa.record_batch([pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["ids", "v"])

    def pack(batches):
        ids, v = [], []
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            while len(own):
                n = block - sum(map(len, ids))
                ids.append(own[:n])
                v.append(_matrix(batch.column(1).slice(batch.num_rows - len(own), n).to_pandas()))
                own = own[n:]
                if sum(map(len, ids)) == block:
                    yield record(np.concatenate(ids), np.concatenate(v))
                    ids, v = [], []
        if ids:
            yield record(np.concatenate(ids), np.concatenate(v))

    return cut_lineage(df.select(id, "v").mapInArrow(pack, "ids binary, v binary").withColumn("block", F.monotonically_increasing_id()))


def compare_all(asked: DataFrame, points: DataFrame, k: int, block: int) -> DataFrame:
    """``q, neighbour_id, d2`` of the ``k`` nearest of some parts of the points for each query; among them are the ``k`` nearest of all."""
    spark, schema = asked.sparkSession, "q bigint, neighbour_id bigint, d2 double"
    queries = _packed(asked, "q", block).select("block", F.col("ids").alias("qs"), F.col("v").alias("qv"))
    base = _packed(points, "id", block).select("ids", "v")
    # A task holds few blocks of queries and reads all base blocks, so it returns k rows a query; with few queries the base is cut too.
    wanted, blocks = 8 * spark.sparkContext.defaultParallelism, queries.count()
    groups = max(min(wanted, blocks), math.ceil(blocks / HELD))
    parts = math.ceil(wanted / max(1, groups))

    def match(batches):
        held = {}
        for batch in batches:
            for ids, v, at, qs, qv in zip(*(c.to_pylist() for c in batch.columns)):
                if at not in held:
                    qs = np.frombuffer(qs, np.int64)
                    held[at] = qs, Best(np.frombuffer(qv).reshape(len(qs), -1), k)
                ids = np.frombuffer(ids, np.int64)
                held[at][1].add(np.frombuffer(v).reshape(len(ids), -1), ids)
        for qs, best in held.values():
            r, i, d = best.found()
            yield pa.record_batch([pa.array(qs[r], pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["q", "neighbour_id", "d2"])

    # The right side's part is held, the left one's rows pass by once.
    pairs = base.coalesce(parts).hint("shuffle_replicate_nl").crossJoin(queries.repartition(groups).hint("shuffle_replicate_nl"))
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "4")  # a row is two blocks
    try:
        return cut_lineage(pairs.select("ids", "v", "block", "qs", "qv").mapInArrow(match, schema))
    finally:
        spark.conf.set(ARROW_ROWS, before)


def nearest(queries: DataFrame, base: DataFrame, k: int, id: str = "id", vector: str = "vector",
            exclude_self: bool = False, block: int = BLOCK, max_pivots: int = MAX_PIVOTS,
            probes: int | None = None) -> DataFrame:
    """``query_id, neighbour_id, distance, rank``: the ``k`` nearest base rows of each query row.

    Euclidean distance, ties by neighbour id. ``exclude_self`` leaves out the row with the query's own id.
    The result is exact unless ``probes`` is given, see :func:`nearest_approximate`. Null vectors and ids are left out.
    """
    kk = k + 1 if exclude_self else k
    queries, points, asked = prepared(queries, base, kk, id, vector)
    n_points, n_asked = points.count(), asked.count()
    if n_points == 0:
        raise ValueError("no base rows")
    # A bounded sample of vectors and one row of statistics per pivot are all the driver sees.
    wanted = min(max_pivots, math.ceil(n_points / block))
    sample = points.select("v").distinct().orderBy(F.xxhash64("v")).limit(wanted).collect()
    pivots = _matrix(pd.Series([r.v for r in sample]))
    n_pivots = len(pivots)

    @F.pandas_udf("struct<cell: int, dist: double>")
    def home(v: pd.Series) -> pd.DataFrame:
        d = _pivot_distances(_matrix(v), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "dist": d[np.arange(len(d)), cell]})

    size, near, far = np.array([n_points] + [0] * (n_pivots - 1)), np.zeros(n_pivots), np.full(n_pivots, np.inf)
    if n_pivots == 1:
        placed = points.withColumn("cell", F.lit(0))
    else:
        placed = cut_lineage(points.withColumn("h", home("v")).select("id", "v", "h.*"))
        near, far = np.full(n_pivots, np.inf), np.full(n_pivots, -np.inf)
        for s in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"),
                                            F.max("dist").alias("hi")).collect():
            size[s.cell], near[s.cell], far[s.cell] = s.n, s.lo, s.hi
    blocks = np.maximum(1, -(-size // block))
    n_blocks = F.array(*[F.lit(int(b)) for b in blocks])
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("id"), F.element_at(n_blocks, F.col("cell") + 1)))

    apart = _pivot_distances(pivots, pivots)

    @F.pandas_udf("array<int>")
    def visits(v: pd.Series, reach: pd.Series) -> pd.Series:
        d = _pivot_distances(_matrix(v), pivots)
        least = np.maximum(d - far[None, :], near[None, :] - d)
        # Rows of another cell lie beyond the plane half-way between its pivot and the query's own.
        own = d.argmin(axis=1)
        gap = apart[own]
        plane = (d ** 2 - (d[np.arange(len(d)), own] ** 2)[:, None]) / np.where(gap > 0, 2 * gap, np.inf)
        least = np.maximum(least, plane)
        tolerance = 1e-9 * (1 + d)
        limit = reach.to_numpy(dtype="float64", na_value=np.inf)[:, None]
        ok = (least - tolerance <= limit) & (size > 0)[None, :]
        return pd.Series([np.nonzero(row)[0].astype("int32") for row in ok])

    def search(visiting: DataFrame, n_chunks: np.ndarray) -> DataFrame:
        """k nearest within each visited block; ``visiting`` has ``q, v, cell, sub, chunk``."""
        copies = F.array(*[F.lit(int(c)) for c in n_chunks])
        spread = placed.withColumn("chunk", F.explode(F.sequence(
            F.lit(0), F.element_at(copies, F.col("cell") + 1) - 1)))

        def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"q": [], "neighbour_id": [], "d2": []})
            ids = right["id"].to_numpy()
            r, c, d = _nearest_in_block(_matrix(left["v"]), _matrix(right["v"]), ids, kk)
            return pd.DataFrame({"q": left["q"].to_numpy()[r], "neighbour_id": ids[c], "d2": d})

        key = ["cell", "sub", "chunk"]
        return ranks(visiting.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(
            match, "q bigint, neighbour_id bigint, d2 double"))

    def ranks(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy("d2", "neighbour_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= kk)

    def chunked(cells: DataFrame, total: int) -> tuple[DataFrame, np.ndarray]:
        """Assign visiting queries of each cell to chunks of about ``block`` rows."""
        n = np.ones(n_pivots, int)
        if total > block:
            for row in cells.groupBy("cell").agg(F.count("*").alias("n")).collect():
                n[row.cell] = max(1, -(-row.n // block))
        counts = F.array(*[F.lit(int(c)) for c in n])
        return cells.withColumn("chunk", F.pmod(
            F.xxhash64("q", F.lit(7)), F.element_at(counts, F.col("cell") + 1)).cast("int")), n

    def with_vectors(visited: DataFrame) -> DataFrame:
        # The table of visits is small as a file but holds many rows per query: it must not be broadcast by its size.
        return cut_lineage(visited).join(asked.hint("merge"), "q")

    subs = F.element_at(n_blocks, F.col("cell") + 1)
    if n_pivots == 1:
        cells = asked.withColumn("cell", F.lit(0))
    elif probes is not None:
        @F.pandas_udf("array<int>")
        def closest(v: pd.Series) -> pd.Series:
            d = _pivot_distances(_matrix(v), pivots)
            return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype("int32")))

        cells = with_vectors(asked.select("q", F.explode(closest("v")).alias("cell")))
    else:
        def reach_of(some: DataFrame, total: int) -> DataFrame:
            """Any k base rows bound the distance of the k-th nearest: take them from one block at home."""
            first = some.withColumn("cell", home("v")["cell"])
            first = first.withColumn("sub", F.pmod(F.xxhash64("q"), subs))
            first, n = chunked(first, total)
            bound = search(first, n).filter(F.col("rank") == kk).select("q", F.sqrt("d2").alias("reach"))
            return some.join(bound, "q", "left")

        judged = cut_lineage(asked.orderBy(F.xxhash64("q")).limit(JUDGED))
        rows_in = F.array(*[F.lit(int(c)) for c in size])
        seen = reach_of(judged, JUDGED).select(F.explode(visits("v", "reach")).alias("cell")).agg(
            F.sum(F.element_at(rows_in, F.col("cell") + 1))).first()[0] or 0
        if seen > DENSE * n_points * min(JUDGED, n_asked):
            return give_back(queries, asked, ranks(compare_all(asked, points, kk, block)), k, exclude_self)
        # Written once: the visits are counted before they are searched.
        cells = with_vectors(reach_of(asked, n_asked).select("q", F.explode(visits("v", "reach")).alias("cell")))
    cells, n = chunked(cells, n_asked)
    everywhere = cells.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("bigint"), (subs - 1).cast("bigint"))))
    best = search(everywhere, n)

    return give_back(queries, asked, best, k, exclude_self)


def nearest_approximate(queries: DataFrame, base: DataFrame, k: int, id: str = "id", vector: str = "vector",
                        exclude_self: bool = False, probes: int = 8, block: int = BLOCK,
                        max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """:func:`nearest` among the rows of the ``probes`` pivot cells closest to each query.

    Each query is copied to ``probes`` cells at most, so the work per query stays the same while cells hold
    about ``block`` rows (raise ``max_pivots`` with the table). Neighbours in other cells are missed, and a query whose
    cells hold fewer than ``k`` rows gets fewer; distances and ranks are exact among the rows visited.
    """
    if probes < 1:
        raise ValueError("probes must be at least 1")
    return nearest(queries, base, k, id, vector, exclude_self, block, max_pivots, probes)


def knn_classify(queries: DataFrame, base: DataFrame, k: int = 5, id: str = "id", vector: str = "vector",
                 label: str = "label", weights: str = "uniform", search=nearest, **options) -> DataFrame:
    """``id, probability, prediction`` for 0/1 labels: vote of the ``k`` nearest base rows.

    ``weights='distance'`` weighs a vote by inverse distance; exact matches then decide alone. ``search`` finds the
    neighbours, for example ``forest.nearest_forest`` in many dimensions.
    """
    found = search(queries, base, k, id, vector, **options)
    votes = found.join(base.select(F.col(id).alias("neighbour_id"), F.col(label).alias("_y")), "neighbour_id")
    if weights == "distance":
        exact = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(Window.partitionBy("query_id"))
        votes = votes.withColumn("_exact", exact).withColumn(
            "_w", F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double"))
            .otherwise(F.try_divide(F.lit(1.0), F.col("distance"))))
    else:
        votes = votes.withColumn("_w", F.lit(1.0))
    p = F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")
    return (votes.groupBy(F.col("query_id").alias(id)).agg(p.alias("probability"))
            .withColumn("prediction", (F.col("probability") > 0.5).cast("int")))
