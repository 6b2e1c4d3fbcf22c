"""Running sums, exact quantiles and ranks over data of any size.

A window without a partition key would pull all rows into one task. Here the ordered values are cut
into blocks at approximate quantiles; each block is summed on its own and then shifted by the total of
the blocks before it. The results are exact, wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cindergrid.session import cut_lineage


def look_up(df: DataFrame, small: DataFrame, keys: Sequence[str], names: Sequence[str],
            limit: int = 10_000) -> DataFrame:
    """Add the columns ``names`` of ``small``, which has one row for each of a few ``keys``.

    They travel as one map value. A join would first move all of ``df`` into as many partitions as there
    are keys. More than ``limit`` keys are an error.
    """
    values = F.struct(*names)
    if keys:
        entry = F.struct(F.struct(*keys).alias("k"), values.alias("v"))
        # The limit is a row more than asked for, so that the map can't grow before it is refused.
        entries = F.collect_list(entry)
        few = F.when(F.size(entries) > limit, F.raise_error(F.lit(f"more than {limit} keys to look up"))).otherwise(
            F.map_from_entries(entries))
        found = small.limit(limit + 1).agg(few).scalar()[F.struct(*keys)]
    else:
        found = small.select(values).scalar()
    found = df.withColumn("_found", found)
    return found.select(*df.columns, *[F.col(f"_found.{n}").alias(n) for n in names])


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (),
                   ties: Sequence[str] = (), fan: int = 16) -> DataFrame:
    """Add ``cum_<c>`` for each column ``c`` of ``sums``: its sum over all rows up to this one, and
    ``total_<c>``: its sum over all rows of the group.

    ``by`` has few distinct values, such as column names or classes. ``order`` is numeric; ``order`` and ``ties`` together must not repeat within ``by``. Pre-aggregate
    repeated values first, so that copies of one value cannot fill a block. There are ``fan * fan``
    blocks per group, whatever the settings of the session; raise ``fan`` where a block would not fit a task.
    """
    blocks = fan * fan
    cuts = [i / blocks for i in range(1, blocks)]
    approx = F.percentile_approx(order, cuts, max(10_000, 10 * blocks))
    known = df.groupBy(*by).agg(approx.alias("_cuts"), *[F.sum(c).alias(f"total_{c}") for c in sums])
    tagged = look_up(df, known, by, ["_cuts", *[f"total_{c}" for c in sums]])
    # The block number is the number of cuts below the value, found by halving.
    tagged = tagged.withColumn("_block", F.lit(0))
    for i in reversed(range((blocks - 1).bit_length())):
        passed = F.get("_cuts", F.col("_block") + ((1 << i) - 1)) < F.col(order)
        tagged = tagged.withColumn("_block", F.col("_block") + F.when(passed, 1 << i).otherwise(0))
    tagged = tagged.drop("_cuts")

    # At most one row per block and group in ``totals``.
    totals = tagged.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_before_{c}") for c in sums])
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_block", *[
        F.sum(f"_before_{c}").over(ahead).alias(f"_before_{c}") for c in sums])

    inner = Window.partitionBy(*by, "_block").orderBy(order, *ties).rowsBetween(
        Window.unboundedPreceding, 0)
    shifted = tagged.join(offsets, [*by, "_block"])
    return shifted.select(*df.columns, *[f"total_{c}" for c in sums], *[
        (F.sum(c).over(inner) + F.coalesce(f"_before_{c}", F.lit(0))).alias(f"cum_{c}") for c in sums])


def ranked(df: DataFrame, order: str, ties: Sequence[str] = (), name: str = "rank",
           by: Sequence[str] = (), fan: int = 16) -> DataFrame:
    """Add the 1-based position of each row in the order of ``order`` and ``ties``."""
    out = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], by, ties, fan)
    return out.withColumnRenamed("cum__one", name).drop("_one", "total__one")


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by + column, value``: the numeric columns one below the other, without missing values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(
        F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias("value")) for c in columns])
    return df.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*").filter("value is not null")


def with_image(df: DataFrame, value: str, name: str = "x") -> DataFrame:
    """Add a whole number in the order of the doubles ``value``, equal only where they are: their bit pattern, signed.

    In steps, so that the logarithm and the powers are computed once a row.
    """
    x, size = F.col(value), F.col("_size")
    guess = F.least(F.greatest(F.coalesce(F.floor(F.log2(size)), F.lit(-1022)), F.lit(-1022)), F.lit(1023))
    out = df.withColumn("_size", F.least(F.abs(x), F.lit(1.7976931348623157e308))).withColumn("_e", guess)
    out = out.withColumn("_p", F.pow(F.lit(2.0), F.col("_e")))
    # The logarithm may be off next to a power of two.
    up, down = size >= 2 * F.col("_p"), (size < F.col("_p")) & (F.col("_e") > -1022)
    out = out.withColumns({"_e": F.col("_e") + F.when(up, 1).when(down, -1).otherwise(0),
                           "_p": F.col("_p") * F.when(up, 2.0).when(down, 0.5).otherwise(1.0)})
    out = out.withColumn("_code", (F.col("_e") + 1022) * F.lit(1 << 52) + (size / F.col("_p") * float(1 << 52)).cast("long"))
    code = F.when(F.abs(x) == float("inf"), F.lit(2047 << 52)).otherwise(F.col("_code"))
    return out.withColumn(name, F.when(x > 0, code).when(x < 0, -code).otherwise(F.lit(0).cast("long"))).select(*df.columns, name)


def from_image(code: Column) -> Column:
    """The double that :func:`with_image` gives ``code`` for."""
    size = F.abs(code)
    e = F.shiftright(size, 52)
    whole = (size.bitwiseAND(F.lit((1 << 52) - 1)) + F.when(e > 0, F.lit(1 << 52)).otherwise(F.lit(0).cast("long"))).cast("double")
    value = F.when(e == 2047, F.lit(float("inf"))).otherwise(whole * F.pow(F.lit(2.0), F.greatest(e, F.lit(1)) - 1075))
    return F.when(code < 0, -value).otherwise(value)


#: A pass of the selection settles this many bits of the images.
DIGIT = 16


def quantiles(df: DataFrame, columns: Sequence[str], qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per column, one field per entry of ``qs``.

    Radix selection: each pass counts the next 16 bits of the values that share the bits settled so far, in every task
    first, so that counts move and values never do. At most four passes read ``df``; write it first where it is
    costly. A position is settled early once its bits hold one value only.
    """
    keys = [*by, "column"]
    values = long_values(df, columns, by)
    state = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        bucket, above = F.shiftright("x", shift).alias("bucket"), F.shiftright("bucket", DIGIT)
        rows = values
        if state is not None:
            ends = F.struct(from_image(F.col("low")).alias("low"), from_image(F.col("high")).alias("high"))
            few = state.where("low < high").groupBy(*keys).agg(F.collect_set(ends).alias("_open"))
            rows = look_up(values, few, keys, ["_open"]).where(F.exists("_open", lambda o: F.col("value").between(o["low"], o["high"])))
        counts = with_image(rows, "value").groupBy(*keys, bucket).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        counts = counts.withColumn("above", above if state is not None else F.lit(0).cast("long"))
        if state is None:
            counts = cut_lineage(counts)
            positions = [F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), (F.lit(q) * (F.col("size") - 1)).alias("at"))
                         for name, q in qs.items() for up in (False, True)]
            state = counts.groupBy(*keys).agg(F.sum("n").alias("size")).select(*keys, F.explode(F.array(*positions)).alias("p")).select(
                *keys, F.lit(0).cast("long").alias("above"), "p.name", "p.up", (F.col("p.at") - F.floor("p.at")).alias("share"),
                F.when(F.col("p.up"), F.ceil("p.at")).otherwise(F.floor("p.at")).alias("rank"), F.lit(0).cast("long").alias("low"), F.lit(1).cast("long").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "above").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("upto", upto).join(state.where("low < high").drop("low", "high"), [*keys, "above"]).where(
            "upto - n <= rank and rank < upto").select(*keys, F.col("bucket").alias("above"), "name", "up", "share", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high")
        # One row per column, quantile and side.
        state = cut_lineage(found.unionByName(state.where("low = high")))
        if state.where("low < high").isEmpty():
            break

    def at(name: str, up: bool) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("up") == up), from_image(F.col("low"))))

    picked = [c for name in qs for c in (at(name, False).alias(f"_{name}_lo"), at(name, True).alias(f"_{name}_hi"),
                                         F.max(F.when(F.col("name") == name, F.col("share"))).alias(f"_{name}_share"))]
    return state.groupBy(*keys).agg(*picked).select(*keys, *[
        (F.col(f"_{n}_lo") + F.col(f"_{n}_share") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n) for n in qs])
