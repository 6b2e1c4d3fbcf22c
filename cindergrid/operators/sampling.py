"""Splits, folds, mini-batches and class balancing. Every choice is a hash of the row's key, so a
recomputed task always makes the same one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.operators.neighbors import nearest
from cindergrid.operators.ranking import ranked, running_totals
from cindergrid.session import cut_lineage


def key_hash(keys: Sequence[Column | str], seed: int = 42) -> Column:
    """Uniform 32-bit number from the key columns and a seed (first 8 hex digits of an MD5)."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def random_split(df: DataFrame, keys: Sequence[Column | str], test_share: float = 0.2, seed: int = 42,
                 name: str = "split") -> DataFrame:
    """``split`` is ``test`` for about ``test_share`` of the keys, else ``train``. Splitting by date keeps
    whole days together."""
    cut = round(test_share * 2**32)
    return df.withColumn(name, F.when(key_hash(keys, seed) < cut, "test").otherwise("train"))


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, test_share: float = 0.2,
                     seed: int = 42, name: str = "split") -> DataFrame:
    """As :func:`random_split`, with exactly ``round(share * n)`` test rows in every class.

    Rows are ranked by hash within each class; ``keys`` must be unique.
    """
    hashed = df.withColumn("_h", key_hash(keys, seed))
    placed = running_totals(hashed.withColumn("_one", F.lit(1)), "_h", ["_one"], by=[label], ties=keys)
    test = F.col("cum__one") <= F.round(F.col("total__one") * test_share)
    return placed.withColumn(name, F.when(test, "test").otherwise("train")).select(*df.columns, name)


def with_fold(df: DataFrame, keys: Sequence[Column | str], folds: int = 5, seed: int = 42,
              name: str = "fold") -> DataFrame:
    return df.withColumn(name, (key_hash(keys, seed) % folds).cast("int"))


def shuffled_batches(days: DataFrame, batch_size: int, seed: int = 42, day: str = "day_idx") -> DataFrame:
    """``day, batch``: sample days in seeded random order cut into full batches; an incomplete last batch
    is left out.

    The order is an array of day numbers in one row, at most one entry per calendar day.
    """
    pairs = F.array_sort(F.collect_set(F.struct(key_hash([day], seed).alias("h"), F.col(day).alias("day"))))
    order = days.agg(pairs.alias("order"))
    placed = order.select(F.size("order").alias("n"), F.posexplode("order").alias("pos", "x"))
    batch = F.floor(F.col("pos") / batch_size)
    return (placed.filter(batch < F.floor(F.col("n") / batch_size))
            .select(F.col("x.day").alias(day), batch.cast("int").alias("batch")))


def class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    """Number of rows with label 0 and label 1."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).first()
    return row.a, row.b


def smote(df: DataFrame, id: str = "id", vector: str = "vector", label: str = "label", k: int = 5,
          seed: int = 42, search=nearest, **options) -> DataFrame:
    """Balance two classes with synthetic minority rows: ``id, copy, vector, label``.

    Each synthetic row lies between a minority row and one of its ``k`` nearest minority rows. Every
    minority row gives the same number of them, and the rows first in hash order give one more until
    the classes are equal. Original rows have ``copy`` 0, synthetic ones 1, 2, ... per base row. ``search`` finds the
    neighbours; it must give every row ``k`` of them.
    """
    zeros, ones = class_sizes(df, label)
    minority, few, many = (1, ones, zeros) if ones < zeros else (0, zeros, ones)
    rows = df.select(F.col(id).cast("bigint").alias(id), F.col(vector).cast("array<double>").alias(vector),
                     F.col(label).cast("int").alias(label))
    originals = rows.select(id, F.lit(0).alias("copy"), vector, label)
    if few == many:
        return originals
    if few <= k:
        raise ValueError(f"{few} rows of the smaller class can't give {k} neighbours each; pass a smaller k")
    need = many - few
    small = rows.filter(F.col(label) == minority).select(id, vector)
    base = ranked(small.withColumn("_h", key_hash([id], seed)), "_h", [id], "_rank")
    each = F.lit(need // few) + (F.col("_rank") <= need % few).cast("int")
    base = base.withColumn("_each", each).filter("_each > 0")
    base = base.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_each").cast("int"))))
    base = base.withColumns({
        "_pick": (key_hash([id, "copy", F.lit("pick")], seed) % k + 1).cast("int"),
        "_step": key_hash([id, "copy", F.lit("step")], seed) / F.lit(2.0**32),
    }).select(id, "copy", "_pick", "_step", F.col(vector).alias("_from"))
    pairs = search(small, small, k, id, vector, exclude_self=True, **options)
    to = small.select(F.col(id).alias("neighbour_id"), F.col(vector).alias("_to"))
    made = (base.join(pairs.select(F.col("query_id").alias(id), F.col("rank").alias("_pick"), "neighbour_id"),
                      [id, "_pick"]).join(to, "neighbour_id"))
    between = F.zip_with("_from", "_to", lambda a, b: a + F.col("_step") * (b - a))
    synthetic = made.select(id, "copy", between.alias(vector), F.lit(minority).alias(label))
    return originals.unionByName(synthetic)


def edited_neighbours(df: DataFrame, id: str = "id", vector: str = "vector", label: str = "label",
                      k: int = 3, search=nearest, **options) -> DataFrame:
    """Drop rows whose ``k`` nearest other rows, found by ``search``, are not all of the row's own class; ``id`` is unique."""
    found = search(df, df, k, id, vector, exclude_self=True, **options)
    other = df.select(F.col(id).alias("neighbour_id"), F.col(label).alias("_y"))
    own = df.select(F.col(id).alias("query_id"), F.col(label).alias("_mine"))
    bad = (found.join(other, "neighbour_id").join(own, "query_id").filter(F.col("_y") != F.col("_mine"))
           .select(F.col("query_id").alias(id)).distinct())
    return df.join(bad, id, "left_anti")


def smote_enn(df: DataFrame, id: str = "id", vector: str = "vector", label: str = "label", k: int = 5,
              clean_k: int = 3, seed: int = 42, **options) -> DataFrame:
    """:func:`smote`, then :func:`edited_neighbours` over originals and synthetic rows together."""
    grown = cut_lineage(smote(df, id, vector, label, k, seed, **options))
    # One number per row: copies of a base row are numbered below it.
    widest = grown.agg((F.max("copy") + 1).cast("bigint")).scalar()
    keyed = grown.withColumn("_row", F.col(id) * widest + F.col("copy"))
    return edited_neighbours(keyed, "_row", vector, label, clean_k, **options).drop("_row")
