"""Aggregates and exact order statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.session import materialize


# D2
def entropy_of_counts(n: Column) -> Column:
    """Entropy in bits from one row per distinct value, in a single aggregate."""
    total = F.sum(n)
    bits = F.log2(total) - F.sum(n * F.log2(n)) / total
    return F.coalesce(F.greatest(bits, F.lit(0.0)), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """NULL on an empty denominator."""
    return F.when(whole != 0, part / whole)


# D7
def nearest_rank(n: Column, fraction: float, rounding: str = "half_even") -> Column:
    """Zero-based rank of a percentile in ``n`` sorted values.

    The product is taken in doubles: a decimal literal would round elsewhere.
    """
    position = F.lit(float(fraction)) * (n - 1).cast("double")
    return (F.bround(position) if rounding == "half_even" else F.floor(position)).cast("bigint")


def ranked(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``rank0`` and ``group_n``. For groups bounded by a number of windows."""
    w = Window.partitionBy(*keys)
    return (rows.filter(F.col(value).isNotNull())
            .withColumn("rank0", F.row_number().over(w.orderBy(value)) - 1)
            .withColumn("group_n", F.count(F.lit(1)).over(w)))


def at_rank(value: str, rank: Column) -> Column:
    return F.max(F.when(F.col("rank0") == rank, F.col(value)))


def percentiles_nearest(rows: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float],
                        rounding: str = "half_even") -> DataFrame:
    n = F.col("group_n")
    return ranked(rows, keys, value).groupBy(*keys).agg(
        *[at_rank(value, nearest_rank(n, f, rounding)).alias(name) for name, f in fractions.items()],
        F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str,
                     ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact values at given ranks of groups of any size; one row per group.

    Rows are folded to ``(keys, value, count)``, dealt out once by ranges of (keys, value) and
    stored, so that a group of any size is spread over as many ranges as it needs. The counts per
    (keys, range), a few rows, tell which range holds each wanted rank; only rows of those ranges
    are looked at again, each range in its order.
    """
    keys, v = list(keys), F.col("_v")
    folded = (rows.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    dealt = materialize(folded.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()), "order-statistics")
    parts = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_c"))
    group = Window.partitionBy(*keys)
    placed = parts.withColumns({
        "_before": F.sum("_c").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"),
        "n": F.sum("_c").over(group)})
    wanted = placed.select(*keys, "_range", "_before", "_c", "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), make(F.col("n")).cast("bigint").alias("rank")) for name, make in ranks.items()])).alias("_w")) \
        .select(*keys, "_range", "n", "_w.name", (F.col("_w.rank") - F.col("_before")).alias("rank"), "_c") \
        .filter((F.col("rank") >= 0) & (F.col("rank") < F.col("_c"))).drop("_c")
    held = _null_safe(dealt, wanted.select(*keys, "_range").distinct(), [*keys, "_range"])
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = _null_safe(held.withColumn("_upto", upto), wanted, [*keys, "_range"]).filter(
        (F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
    values = found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, v)).alias(name) for name in ranks])
    return values.filter("n is not null").select(*keys, "n", *ranks)


# D8
def quantiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """Exact interpolated (type 7) quantiles of groups of any size."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, f in fractions.items():
        ranks["_f_" + name] = lambda n, f=f: F.floor(F.lit(float(f)) * (n - 1))
        ranks["_c_" + name] = lambda n, f=f: F.ceil(F.lit(float(f)) * (n - 1))
    found = order_statistics(rows, keys, value, ranks)
    n = F.col("n")

    def between(name: str, f: float) -> Column:
        low, high = F.col("_f_" + name), F.col("_c_" + name)
        position = F.lit(float(f)) * (n - 1)
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return found.select(*keys, "n", *[between(name, f) for name, f in fractions.items()])


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join whose keys may be NULL, each key kept once."""
    renamed = right.select(*[F.col(c).alias("_r_" + c) if c in on else F.col(c) for c in right.columns])
    condition = None
    for key in on:
        term = F.col(key).eqNullSafe(F.col("_r_" + key))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition).drop(*["_r_" + k for k in on])
