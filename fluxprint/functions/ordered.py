"""Order-dependent building blocks that never sort one whole key in one task.

A plain ``lag`` over a device puts every row of that device into one task. The
helpers below cut the time axis into slices, work inside ``(key, slice)``, and
carry only one summary row per slice across the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unfolded(table: DataFrame) -> DataFrame:
    """A table that has far more rows than its stored bytes tell; its next join sorts both sides.

    A grid is a few columns per device unfolded to windows, and stored it compresses well. Spark's
    size check sees the few bytes, takes it for small and would send all rows through the driver.
    """
    return table.hint("merge")


def growing(table: DataFrame) -> DataFrame:
    """A table with some rows per device, address or edge; its next join sorts both sides.

    While such a table is under the broadcast threshold the driver gathers all its rows, which take
    many times their stored bytes there, and a plan with several such joins holds them all at once.
    """
    return table.hint("merge")


def consecutive_points(points: DataFrame, keys: Sequence[str], t: str, slice_seconds: float) -> DataFrame:
    """Distinct points of each key with the point before them.

    Returns ``keys, t, n, prev_t``: ``n`` rows share the instant ``t`` and
    ``prev_t`` is the next earlier instant of the key (NULL for the first).
    Equal instants are folded by the partial aggregate before any shuffle, so a
    hot key costs its distinct instants only, spread over its slices.
    """
    keys = list(keys)
    folded = (points.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("_slice", F.floor(F.col(t) / F.lit(slice_seconds))))
    inside = (folded.withColumn("prev_t", F.lag(t).over(Window.partitionBy(*keys, "_slice").orderBy(t)))
              .filter(F.col("prev_t").isNotNull()).select(*keys, t, "n", "prev_t"))
    # The first point of a slice looks at the last point of the slice before it.
    heads = (folded.groupBy(*keys, "_slice")
             .agg(F.min(t).alias("_first"), F.max(t).alias("_last"), F.min_by("n", t).alias("n"))
             .withColumn("prev_t", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")))
             .select(*keys, F.col("_first").alias(t), "n", "prev_t"))
    return inside.unionByName(heads)


def gap_moments(points: DataFrame, keys: Sequence[str], t: str, slice_seconds: float) -> DataFrame:
    """Count and population variance of the gaps inside each key, zero gaps kept.

    Positive gaps are measured; the ``n - 1`` zero gaps of an instant with ``n``
    rows enter by the usual formula for merging two groups' moments.
    """
    gap = F.col(t) - F.col("prev_t")
    moments = consecutive_points(points, keys, t, slice_seconds).groupBy(*keys).agg(
        F.count(gap).alias("_n1"), F.avg(gap).alias("_m1"), F.var_pop(gap).alias("_v1"),
        F.sum(F.col("n") - 1).alias("_n0"))
    n1, n0 = F.col("_n1"), F.col("_n0")
    total = n1 + n0
    between = n1 * n0 / total * F.coalesce("_m1", F.lit(0.0)) * F.coalesce("_m1", F.lit(0.0))
    variance = (n1 * F.coalesce("_v1", F.lit(0.0)) + between) / total
    return moments.select(*keys, total.alias("gaps"), F.when(total >= 2, variance).alias("gap_variance"))


# G1
def availability_epochs(minutes: DataFrame, keys: Sequence[str], order: str, step: int,
                        available: str = "available", identity: str | None = None) -> DataFrame:
    """Number the stretches in which memory is kept.

    A stretch ends with an unavailable row, a missing row, or a changed
    identity. The rows are per key and window, so a key is bounded by time.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    broke = ~F.lag(available).over(w) | (F.col(order) - F.lag(order).over(w) != step)
    if identity:
        broke = broke | ~F.lag(identity).over(w).eqNullSafe(F.col(identity)) & F.lag(order).over(w).isNotNull()
    marked = minutes.withColumn("_broke", F.coalesce(broke, F.lit(False)).cast("int"))
    return (marked.withColumn("epoch", F.sum("_broke").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("_broke"))


def islands(rows: DataFrame, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """Position of each row in its run of evenly spaced rows, starting at 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    anchored = rows.withColumn("_anchor", F.col(order) - F.lit(step) * F.row_number().over(w))
    run = Window.partitionBy(*keys, "_anchor").orderBy(order)
    return anchored.withColumn("consecutive", F.row_number().over(run)).drop("_anchor")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark limits each map task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def running_lookup(points: DataFrame, marks: DataFrame, keys: Sequence[str], t: str, value: str, slice_seconds: float,
                   best: Callable[[str], Column] = F.max, out: str = "found", inclusive: bool = True) -> DataFrame:
    """``points`` with the best ``value`` among the marks of their key up to their instant ``t``.

    Both sides have ``keys`` and ``t``; a mark at the point's own instant counts only if ``inclusive``.
    ``best`` is an aggregate that can be taken piece by piece, as ``max`` and ``min``. Points and marks
    are sorted together within ``(key, slice)`` and one best value per slice is carried over, so a
    point meets no mark that it does not need: the result has as many rows as ``points``.
    """
    keys = list(keys)
    sides = (0, 1) if inclusive else (1, 0)
    rows = points.withColumn("_t", F.col(t).cast("double")).withColumn("_side", F.lit(sides[1])).withColumn("_point", F.lit(True))
    held = marks.select(*keys, F.col(t).cast("double").alias("_t"), F.col(value).alias("_value")).withColumn("_side", F.lit(sides[0]))
    both = rows.unionByName(held, allowMissingColumns=True).withColumn("_slice", F.floor(F.col("_t") / F.lit(slice_seconds)))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "_slice").agg(best("_value").alias("_best")).select(*keys, "_slice", best("_best").over(earlier).alias("_before"))
    placed = both.withColumn("_here", best("_value").over(inside)).filter("_point").join(growing(carried), [*keys, "_slice"])
    pick = F.greatest if best is F.max else F.least
    return placed.withColumn(out, pick("_here", "_before")).drop("_t", "_side", "_point", "_value", "_slice", "_here", "_before")


def cover(first: Column, end: Column, levels: int) -> Column:
    """The fewest dyadic nodes ``(level, node)`` that make up the whole numbers from ``first`` to before ``end``.

    At most two per level; a range of under ``2 ** levels`` numbers is covered in full.
    """
    nodes = []
    for level in range(levels):
        lo, hi = F.ceil(first / F.lit(1 << level)).cast("bigint"), F.floor(end / F.lit(1 << level)).cast("bigint")
        left, right = (lo % 2 != 0) & (lo < hi), (hi % 2 != 0) & (lo + F.abs(lo % 2) < hi)
        nodes += [F.when(on, F.struct(F.lit(level).alias("level"), node.alias("node"))) for on, node in ((left, lo), (right, hi - 1))]
    return F.array_compact(F.array(*nodes))


def nodes_over(number: Column, levels: int) -> Column:
    """The dyadic nodes ``(level, node)`` that hold a whole number, one per level."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.floor(number / F.lit(1 << level)).cast("bigint").alias("node")) for level in range(levels)])
