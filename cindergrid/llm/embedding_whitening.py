"""Whitening of embeddings: Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries c become whole numbers floor(1024 c) + 100000, so sums are exact and rows are centred without loss: a centred
entry is (n x - S) / n with a whole numerator. Left vectors are as long as the table and stay in it: u = X g, with one short
g each. A step sends g to the rows, which are packed to blocks once, and each task gives back X'(X g) and |X g|^2 of its
rows; Spark adds them up by dimension. Both sides are orthogonalised in full at every step, the left one through u_j' w = g_j' X'w;
where that changes w by more than rounding, the products are taken again.

The process ends when the residuals of the wanted singular triplets are at rounding level and what is left of the
variance outside the right vectors is below the smallest wanted one, so that no direction can have been missed (equal
singular values included), or when all dimensions are used. It starts anew, orthogonal to what it has, where a space closes early.

Rows are left out where the vector is null or holds a null, NaN or infinite entry, and where its length isn't the commonest one
(of several, the longest). Entries whose image passes 2^62 count as 2^62. ``deviation`` is null where it passes the range of a long.
Components whose deviation is none, or lost in the rounding of the largest, are left out, so constant tables and empty ones give no rows. Null and repeated ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from cindergrid.llm import arrays
from cindergrid.session import cut_lineage

SCALE, SHIFT, BOUND = 1024, 100_000, 2**62
EPS = float(np.finfo(float).eps)
#: Rows that a task multiplies at once.
ROWS = 4096


def images(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each row remains, its length, and the whole-number images of all entries of the rows that do."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    last = np.cumsum(size)
    kept = column.is_valid().to_numpy(zero_copy_only=False) & (bad[last] == bad[last - size])
    whole = flat[np.repeat(kept, size)]
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(SCALE * whole), -float(BOUND), float(BOUND))
    return kept, size, np.clip(scaled.astype(np.int64) + SHIFT, -BOUND, BOUND)


def packed(df: DataFrame, vector_col: str) -> DataFrame:
    """``width, n, block``: the remaining vectors of one length, row by row as 32-bit or, where they need it, 64-bit numbers."""

    def run(batches):
        for batch in batches:
            kept, size, x = images(batch.column(0))
            lengths, out = size[kept], []
            starts = np.cumsum(lengths) - lengths
            for width in np.unique(lengths[lengths > 0]).tolist():
                rows = starts[lengths == width]
                for at in range(0, len(rows), ROWS):
                    block = x[rows[at : at + ROWS, None] + np.arange(width)]
                    small = np.abs(block).max() < 2**31
                    out.append((width, len(block), block.astype(np.int32 if small else np.int64).tobytes()))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), arrays.binary(list(columns[2]))], ["width", "n", "block"])

    return df.select(F.col(f"`{vector_col}`").cast("array<double>")).mapInArrow(run, "width int, n long, block binary")


def _matrix(block: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(block, np.int32 if len(block) == 4 * n * width else np.int64).reshape(n, width)


class Centre:
    """Number of rows, exact sums and largest image by dimension."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums = n, sums
        #: Numerators n x - S fit 64 bits.
        self.fits = 2 * n * max(largest, 1) < 2**63

    def numerators(self, x: np.ndarray) -> np.ndarray:
        if self.fits:
            return x.astype(np.int64) * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squared numerators; squares are positive, so a total that fits a long had no part that didn't."""
        d = self.numerators(x)
        about = (d.astype(float) ** 2).sum(1)
        with np.errstate(over="ignore"):
            exact = (d * d).sum(1)
        out = exact.tolist()
        for i in np.flatnonzero(about > 2**63 * (1 - 1e-9)).tolist():
            total = sum(int(v) ** 2 for v in d[i]) if about[i] < 2**63 * (1 + 1e-9) else 2**63
            out[i] = total if total < 2**63 else None
        return out


def _summed(blocks: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """``work`` gives ``length`` numbers for the rows of a block; their sums over all blocks, added by Spark."""

    def run(batches):
        total = np.zeros(length)
        for batch in batches:
            for n, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += work(_matrix(block.as_buffer(), n, width))
        yield pa.record_batch([pa.array(range(length), pa.int32()), pa.array(total)], ["i", "value"])

    out = np.zeros(length)
    for r in blocks.select("n", "block").mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[r.i] = r.value
    return out


def centre(blocks: DataFrame, width: int) -> Centre:
    def run(batches):
        total, n, largest = [0] * width, 0, 0
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = _matrix(block.as_buffer(), k, width)
                top = int(np.abs(x).max())
                part = (x.astype(object) if top * k >= 2**63 else x).sum(0, dtype=object if top * k >= 2**63 else np.int64)
                total = [a + int(b) for a, b in zip(total, part)]
                n, largest = n + k, max(largest, top)
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([Decimal(s) for s in total], pa.decimal128(38)),
                               pa.array([n] * width, pa.int64()), pa.array([largest] * width, pa.int64())], ["i", "s", "n", "largest"])

    found = blocks.select("n", "block").mapInArrow(run, "i int, s decimal(38,0), n long, largest long").groupBy("i").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("largest").alias("largest")).orderBy("i").collect()
    return Centre(found[0].n, [int(r.s) for r in found], found[0].largest)


def _orthogonal(r: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            r = r - (b @ r) * b
    return r


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading singular values and right vectors (as rows) of the centred rows X, sum of all squared entries, and the steps taken.

    ``product`` maps g to X'(X g), followed by |X g|^2 and |X|^2."""
    random = np.random.Generator(np.random.PCG64(4242))

    def fresh(basis):
        r = _orthogonal(random.standard_normal(width), basis)
        return r / np.linalg.norm(r)

    right = [fresh([])]
    left, image = np.zeros((0, width)), np.zeros((0, width))  # g_j, and X'u_j
    diagonal, above, energy, closed = [], [], 0.0, False
    while True:
        k = len(diagonal)
        g = right[k] - (above[k - 1] * left[k - 1] if k else 0.0)
        p = product(g)
        energy = p[-1]
        seen = left @ p[:width]
        off, size = np.abs(seen).max(initial=0.0), np.sqrt(max(p[width], 0.0))
        g, h, square = g - seen @ left, p[:width] - seen @ image, p[width]
        if off > 1e3 * EPS * size:
            p = product(g)
            again = left @ p[:width]
            g, h = g - again @ left, p[:width] - again @ image
            square = p[width] - again @ again
        alpha = np.sqrt(max(square, 0.0))
        small = 100 * EPS * np.sqrt(energy)
        if alpha > small:
            left, image = np.vstack([left, g / alpha]), np.vstack([image, h / alpha])
            r = _orthogonal(h / alpha - alpha * right[k], right)
        else:
            # X v adds nothing to the left vectors: a row of zeros, and a new start.
            alpha, r = 0.0, np.zeros(width)
            left, image = np.vstack([left, np.zeros(width)]), np.vstack([image, np.zeros(width)])
        diagonal.append(alpha)
        beta = float(np.linalg.norm(r))
        b = np.diag(diagonal) + np.diag(above, 1)
        p_left, values, q = np.linalg.svd(b)
        top = min(wanted, len(values))
        if len(diagonal) == width or energy == 0:
            break
        closed = beta <= small
        residual = 0.0 if closed else beta * np.abs(p_left[-1, :top]).max()
        rest = energy - float((np.array(diagonal) ** 2).sum() + (np.array(above) ** 2).sum())
        if top == wanted and residual <= 10 * EPS * values[0] and max(rest, 1e3 * EPS * energy) < values[top - 1] ** 2:
            break
        right.append(fresh(right) if closed else r / beta)
        above.append(0.0 if closed else beta)
    return values[:top], (q @ np.array(right))[:top], energy, len(diagonal)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per remaining row and component: ``id_col, component`` (from 1, by falling variance), ``n, deviation, whitened, explained``
    (share of the variance), ``identity_error`` (of the covariance of ``whitened``)."""
    spark = df.sparkSession
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = StructType([df.select(F.col(f"`{id_col}`").alias("id")).schema["id"]])
    for name, kind in zip(names[1:], [IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType()]):
        schema = schema.add(name, kind)
    blocks = cut_lineage(packed(df, vector_col))
    common = blocks.groupBy("width").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    width = common.width
    blocks = blocks.where(F.col("width") == width)
    middle = centre(blocks, width)

    def product(g):
        def work(x):
            rows = middle.rows(x)
            y = rows @ g
            return np.concatenate([y @ rows, [y @ y, np.einsum("ij,ij->", rows, rows)]])
        return _summed(blocks, width, work, width + 2)

    values, vectors, energy, _ = bidiagonalise(product, width, min(components, width))
    varied = values > 1e3 * EPS * max(values[0], np.sqrt(energy)) if energy > 0 else np.zeros(len(values), bool)
    values, vectors = values[varied], vectors[varied]
    weights = (vectors / (values / np.sqrt(middle.n))[:, None]).T
    count = len(values)
    if not count:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def moments(x):
        z = middle.rows(x) @ weights
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    m = _summed(blocks, width, moments, count + count * count) / middle.n
    error = float(np.abs(m[count:].reshape(count, count) - np.outer(m[:count], m[:count]) - np.eye(count)).max())
    explained = values**2 / energy

    def run(batches):
        for batch in batches:
            kept, size, x = images(batch.column(1))
            rows = np.flatnonzero(kept & (size == width))
            lengths = size[kept]
            starts = (np.cumsum(lengths) - lengths)[lengths == width]
            for at in range(0, len(rows), ROWS):
                block = x[starts[at : at + ROWS, None] + np.arange(width)]
                z = middle.rows(block) @ weights
                ids = batch.column(0).take(pa.array(np.repeat(rows[at : at + ROWS], count)))
                deviation = pa.array(middle.deviations(block), pa.int64()).take(pa.array(np.repeat(np.arange(len(block)), count)))
                total = len(block) * count
                yield pa.record_batch([ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(block))),
                                       pa.array(np.full(total, middle.n, np.int64)), deviation, pa.array(z.ravel()),
                                       pa.array(np.tile(explained, len(block))), pa.array(np.full(total, error))], ["id", *names[1:]])

    found = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)
