"""Exact ranks, quantiles and row numbers without a one-task window.

A window over a whole table runs in one task. Here the values are first
counted (one row per distinct value), then cut into buckets by an
order-preserving function of the value itself. Running totals are taken inside
each bucket in parallel; only the bucket totals, whose number is bounded by the
bucket function and not by the data, meet in one small window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_OCTAVE = 64  # buckets per doubling of the value


def value_bucket(c: Column) -> Column:
    """Order-preserving bucket number; about 1 % relative width."""
    c = c.cast("double")
    # infinite values and NaN share the last bucket of their sign
    size = F.floor(F.least(F.log2(F.abs(c)), F.lit(1100.0)) * F.lit(_PER_OCTAVE)) + F.lit(100000)
    return F.when(c > 0, size).when(c < 0, -size).otherwise(F.lit(0).cast("long"))


def _rejoin(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a null key equals a null key."""
    names = {k: f"_k_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, same or None, how).drop(*names.values())


def ordered_histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, value, n, before, total)``: copies of each value, rows before it, rows in all."""
    by = list(by)
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    hist = hist.withColumn("_b", value_bucket(F.col(value)))
    inner = Window.partitionBy(*by, "_b").orderBy(value)
    hist = hist.withColumn("_in", F.sum("n").over(inner) - F.col("n"))
    blocks = hist.groupBy(*by, "_b").agg(F.sum("n").alias("_bn"))
    outer = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b")
    blocks = blocks.select(
        *by, "_b",
        (F.sum("_bn").over(outer) - F.col("_bn")).alias("_off"),
        F.sum("_bn").over(Window.partitionBy(*(by or [F.lit(0)]))).alias("total"),
    )
    return _rejoin(hist, blocks, [*by, "_b"]).select(
        *by, value, "n", (F.col("_in") + F.col("_off")).alias("before"), "total"
    )


def percent_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "percent_rank") -> DataFrame:
    """``(min rank - 1) / (n - 1)`` for each row; 0 in a group of one, null for a null value."""
    by = list(by)
    rank = ordered_histogram(df, value, by).select(
        *by, value,
        F.coalesce(F.try_divide(F.col("before").cast("double"), (F.col("total") - 1).cast("double")), F.lit(0.0)).alias(name),
    )
    return _rejoin(df, rank, [*by, value], "left")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """Ascending rank with the mean rank for ties; null for a null value."""
    by = list(by)
    rank = ordered_histogram(df, value, by).select(
        *by, value, (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(name)
    )
    return _rejoin(df, rank, [*by, value], "left")


def quantiles(df: DataFrame, value: str, p: float, by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """Quantile with linear interpolation between order statistics (type 7), one row per group."""
    by = list(by)
    hist = ordered_histogram(df, value, by)
    pos = (F.col("total") - 1) * F.lit(float(p))
    end = F.col("before") + F.col("n")
    lo = F.floor(pos)
    agg = hist.groupBy(*by).agg(
        F.min(F.when(end > lo, F.col(value))).cast("double").alias("_lo"),
        F.min(F.when(end > F.least(lo + 1, F.col("total") - 1), F.col(value))).cast("double").alias("_hi"),
        F.max(pos - lo).alias("_f"),
    )
    return agg.select(*by, (F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).alias(name))


def scalar_quantile(df: DataFrame, value: str, p: float) -> Column:
    """The same quantile of a whole column, as a scalar sub-query usable in any expression."""
    return quantiles(df, value, p).scalar()


def occurrence_numbers(df: DataFrame, by: Sequence[str], order: str, name: str = "rn") -> DataFrame:
    """1, 2, 3 … inside each group by an integer order column, nulls last.

    A group may be arbitrarily large: its rows are numbered in blocks of
    neighbouring order values and the block sizes are added up.
    """
    by = list(by)
    df = df.withColumn("_b", F.shiftright(F.col(order).cast("long"), 16))
    inner = Window.partitionBy(*by, "_b").orderBy(F.col(order).asc_nulls_last())
    sizes = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_b").asc_nulls_last())
    sizes = sizes.select(*by, "_b", (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    out = df.withColumn("_in", F.row_number().over(inner))
    return _rejoin(out, sizes, [*by, "_b"]).withColumn(name, F.col("_in") + F.col("_off")).drop("_b", "_in", "_off")


def numbered(df: DataFrame, value: str, tie: str, name: str = "rn", by: Sequence[str] = ()) -> DataFrame:
    """Number all rows (of each group) by ``value`` descending, nulls last, ties by the integer column ``tie``."""
    by = list(by)
    keyed = df.withColumn("_v", -F.col(value))
    start = ordered_histogram(keyed, "_v", by).select(*by, "_v", F.col("before").alias("_start"))
    ties = occurrence_numbers(keyed, [*by, "_v"], tie, "_tie")
    valued = keyed.groupBy(*by).agg(F.count("_v").alias("_valued"))
    out = _rejoin(_rejoin(ties, start, [*by, "_v"], "left"), valued, by) if by else (
        _rejoin(ties, start, ["_v"], "left").withColumn("_valued", valued.scalar()))
    place = F.coalesce("_start", "_valued") + F.col("_tie")
    return out.withColumn(name, place).drop("_v", "_start", "_tie", "_valued")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, ties: bool = False, name: str | None = None) -> DataFrame:
    """Best ``n`` rows per group. Spark cuts each group before the shuffle, so hot groups stay small."""
    window = Window.partitionBy(*by).orderBy(*order)
    rank = F.rank() if ties else F.row_number()
    out = df.withColumn("_rk", rank.over(window)).where(F.col("_rk") <= n)
    return out.withColumnRenamed("_rk", name) if name else out.drop("_rk")

