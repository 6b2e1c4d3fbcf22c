"""Language ID: nearest centroid of normalised TF-IDF n-gram vectors, several centroids per language, by cosine.

A text's vector counts its lower-cased byte trigrams in 2^``BITS`` hashed bins (square root of the count times inverse
document frequency, unit length). Document frequencies are counted over all training texts. Centroids come from
spherical k-means within each language, fitted on at most about ``fit_rows`` training texts chosen by a hash of the
text. The prediction is the language of the centroid of largest cosine; ``rejected`` marks texts farther from it
than nearly all (``tail``) of its fitted members.

Texts that are null or without letters are ``und`` with score 0. Texts without any trigram of the training data take the
language of the first centroid, rejected. Null labels don't train. Repeated rows count and are predicted row by row.
Without training texts all are ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cindergrid.llm import arrays, sharing

BITS = 12
BINS = 1 << BITS
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def counts(column):
    """Row number, trigram counts in bins, and whether the text has a letter, for each row of a column."""
    for row, _, data, offsets in arrays.slices(column):
        low = arrays.LOWER[data].astype(np.uint32)
        low[arrays.SEPARATOR[data]] = 32
        gram = (low[:-2] | low[1:-1] << 8 | low[2:] << 16) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS) if len(low) > 2 else low[:0]
        letter = np.append(0, np.cumsum(_LETTER[data]))
        wide = np.append(0, np.cumsum(data >= 0xC0))
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            has = letter[b] > letter[a] or (wide[b] > wide[a] and any(map(str.isalpha, data[a:b].tobytes().decode("utf-8", "replace"))))
            yield row + i, np.bincount(gram[a : max(a, b - 2)], minlength=BINS), bool(has)


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(n) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each bin, and texts in all; every task adds up its own before the shuffle."""

    def run(batches):
        seen, total = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for _, n, _ in counts(batch.column(0)):
                seen += n > 0
                total += 1
        yield pa.record_batch([pa.array(np.arange(-1, BINS), pa.int32()), pa.array(np.append(total, seen), pa.int64())], ["bin", "n"])

    rows = texts.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BINS + 1, np.int64)
    for r in rows:
        out[r.bin] = r.n
    return out[:-1], int(out[-1])


def cluster(x: np.ndarray, k: int, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-point seeds: unit centroids, and each row's cosine to its own."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cosines = x @ c.T
    return c, cosines.max(1)


def train(docs: DataFrame, held: Column, text_col: str, lang_col: str, fit_rows: int, per_language: int, tail: float):
    """(idf, centroids, language of each, least cosine of each), or None without labelled training texts."""
    known = docs.where(~held & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df, total = frequencies(known.select("text"))
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 0.01
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    share = {g: fit_rows / len(sizes) / n for g, n in sizes.items()}
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.lit(0.0)
    for g, s in share.items():
        limit = F.when(F.col("lang") == g, F.lit(float(s))).otherwise(limit)
    some = known.where(draw < limit).distinct()

    def run(batches):
        for batch in batches:
            out = [n.astype(np.uint16 if n.max(initial=0) < 65536 else np.int64).astype(np.float32).tobytes() for _, n, _ in counts(batch.column(0))]
            yield pa.record_batch([batch.column(1), arrays.binary(out)], ["lang", "n"])

    sample = some.mapInArrow(run, "lang string, n binary").toArrow().to_pylist()
    centres, langs, least = [], [], []
    for g in sorted(sizes):
        own = sorted(r["n"] for r in sample if r["lang"] == g)
        if own:
            x = vectors(np.frombuffer(b"".join(own), np.float32).reshape(len(own), BINS), idf)
            c, cosines = cluster(x, per_language)
            centres.append(c)
            langs += [g] * len(c)
            least += [float(np.quantile(cosines, tail)) * 0.8] * len(c)
    return (idf, np.concatenate(centres).astype(np.float32), langs, np.array(least)) if centres else None


def predict(docs: DataFrame, model, id_col: str, text_col: str, held: Column) -> DataFrame:
    shared = sharing.share(docs.sparkSession, model)
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def label(rows, letters):
        fitted = sharing.use(shared)
        if fitted is None:
            return ["und"] * len(rows), np.zeros(len(rows)), np.ones(len(rows), bool)
        idf, centres, langs, least = fitted
        cosines = vectors(np.array(rows, np.float32), idf) @ centres.T
        best = cosines.argmax(1)
        top = np.clip(cosines.max(1), 0, 1).astype(float)
        good = np.array(letters)
        return [langs[b] if g else "und" for b, g in zip(best.tolist(), letters)], np.where(good, top, 0.0), ~good | (top < least[best])

    def run(batches):
        for batch in batches:
            langs, scores, far, rows, letters = [], [], [], [], []
            for _, n, has in counts(batch.column(2)):
                rows.append(n)
                letters.append(has)
                if len(rows) == 256:
                    for x, y in zip((langs, scores, far), label(rows, letters)):
                        x.extend(y)
                    rows, letters = [], []
            if rows:
                for x, y in zip((langs, scores, far), label(rows, letters)):
                    x.extend(y)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                   pa.array(far, pa.bool_())], schema.names)
            arrays.give_back()

    return docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 2000,
             per_language: int = 4, tail: float = 0.005) -> DataFrame:
    """Per row: ``id_col``, ``held_out``, ``lang_pred``, ``score`` (cosine, 0 to 1), ``rejected``. Rows with ``held`` don't train."""
    held = F.coalesce(held, F.lit(False))
    return predict(docs, train(docs, held, text_col, lang_col, fit_rows, per_language, tail), id_col, text_col, held)
