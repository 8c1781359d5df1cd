"""Strictly prior history of device windows, and the model input row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.functions.scalars import clip, day_angle, type_one_hot
from fluxprint.schemas import DEVICE_TYPES, EXTERNAL_TYPE, Clock

EPOCH = ["device", "epoch"]


def _prior(clock: Clock, first: int):
    return Window.partitionBy(*EPOCH).orderBy("window_start").rangeBetween(-first * clock.window, -clock.window)


# G2
def history_stack(rows: DataFrame, columns: Sequence[str], clock: Clock) -> DataFrame:
    """Earlier windows of the same epoch, oldest first, at most ``clock.long`` of them.

    An epoch has no gaps, so the frame is contiguous and ends at the window before.
    """
    frame = _prior(clock, clock.long)
    entry = F.struct("window_start", *columns)
    return rows.filter("available").withColumn("history", F.collect_list(entry).over(frame))


# G3
def history_status(grid: DataFrame, clock: Clock) -> DataFrame:
    """How many earlier windows count, since when, and whether that is enough."""
    w = Window.partitionBy(*EPOCH)
    usable = grid.filter("available")
    prior = F.least(F.row_number().over(w.orderBy("window_start")) - 1, F.lit(clock.long))
    age = F.col("window_start") - F.min("window_start").over(w)
    return usable.select("device", "window_start", prior.alias("prior_windows"), (prior == 0).alias("cold"),
                         age.alias("observed_age_seconds"),
                         ((prior == clock.long) & (age >= clock.stream * clock.window)).alias("fully_warmed"))


# G4
def first_seen(rows: DataFrame, keys: Sequence[str], order: str = "window_start") -> Column:
    """True in the first window of a key; put the epoch into the keys to reset with it."""
    return F.col(order) == F.min(order).over(Window.partitionBy(*keys))


# G7
def operating_context(cells: DataFrame, clock: Clock) -> DataFrame:
    """Age, load and direction bands from at most five earlier windows."""
    usable = cells.filter("available")
    order = Window.partitionBy(*EPOCH).orderBy("window_start")
    recent = order.rowsBetween(-clock.short, -1)
    seen = F.row_number().over(order) - 1

    def median(column: str) -> Column:
        values = F.array_sort(F.collect_list(F.col(column).cast("double")).over(recent))
        n = F.size(values)
        low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)

    rows = usable.select("device", "window_start", F.least(seen, F.lit(clock.long)).alias("_seen"),
                         median("active_flows").alias("_all"), median("initiated_flows").alias("_out"),
                         median("inbound_flows").alias("_in"))
    age = F.when(F.col("_seen") < 3, "cold").when(F.col("_seen") < 6, "settling").otherwise("warm")
    load = (F.when(F.col("_all").isNull(), "unknown").when(F.col("_all") == 0, "quiet")
            .when(F.col("_all") <= 4, "light").otherwise("busy"))
    out, inn = F.col("_out"), F.col("_in")
    direction = (F.when(out.isNull() | inn.isNull(), "unknown").when(out + inn == 0, "quiet")
                 .when(inn > 2 * out, "receive").when(out > 2 * inn, "send").otherwise("mixed"))
    return rows.select("device", "window_start",
                       F.concat(age, F.lit("|load="), load, F.lit("|direction="), direction).alias("context"))


# G11
def last_scores(rows: DataFrame, keys: Sequence[str], order: str, k: int = 60) -> DataFrame:
    """The newest ``k`` rows per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= k)


def last_valid(rows: DataFrame, keys: Sequence[str], order: str, scores: Sequence[tuple[str, str]]) -> DataFrame:
    """Newest row with both score and flag, for each (score, flag) pair; partial max_by only."""
    out = []
    for score, flag in scores:
        valid = F.col(score).isNotNull() & F.col(flag).isNotNull()
        for c in (score, flag, order):
            out.append(F.max_by(c, F.when(valid, F.col(order))).alias(f"last_{score}_at" if c == order else f"last_{c}"))
    return rows.groupBy(*keys).agg(*out)


# F18
def normaliser(rows: DataFrame, columns: Sequence[str], log_columns: Sequence[str]) -> DataFrame:
    """Mean and spread per device kind, the pooled ones where a kind has none.

    One row per kind of a fixed vocabulary, so the result is small by construction.
    """
    moved = rows.select("device_type", *[_moved(c, log_columns).alias(c) for c in columns])

    def moments(prefix: str) -> list[Column]:
        return [m for c in columns for m in (F.avg(c).alias(f"{prefix}mean_{c}"), F.stddev_pop(c).alias(f"{prefix}std_{c}"))]

    kinds = F.explode(F.array(*[F.lit(t) for t in [*DEVICE_TYPES, EXTERNAL_TYPE]])).alias("device_type")
    pooled = moved.agg(*moments("g_")).select(kinds, "*")
    own = moved.groupBy("device_type").agg(*moments("t_"), F.count(F.lit(1)).alias("_n"))
    both = pooled.join(own, "device_type", "left")

    def pick(name: str) -> Column:
        return F.when(F.col("_n").isNotNull(), F.col("t_" + name)).otherwise(F.col("g_" + name)).alias(name)

    return both.select("device_type", F.col("_n").isNull().alias("pooled"),
                       *[pick(f"{m}_{c}") for c in columns for m in ("mean", "std")])


def _moved(column: str, log_columns: Sequence[str]) -> Column:
    value = F.col(column).cast("double")
    return F.log1p(value) if column in log_columns else value


def model_input(rows: DataFrame, stats_by_kind: DataFrame, columns: Sequence[str], log_columns: Sequence[str],
                squash: str = "asinh") -> DataFrame:
    """Normalised named columns, validity flags, clock and kind encodings."""
    joined = rows.join(stats_by_kind, "device_type", "left")
    values, valid = [], []
    for c in columns:
        z = (_moved(c, log_columns) - F.col(f"mean_{c}")) / F.col(f"std_{c}")
        z = F.asinh(z) if squash == "asinh" else clip(z, -8.0, 8.0)
        values.append(F.coalesce(z, F.lit(0.0)).alias(f"x_{c}"))
        valid.append(F.col(c).isNotNull().cast("int").alias(f"valid_{c}"))
    angle = day_angle(F.col("window_start"))
    return joined.select("device", "window_start", *values, *valid, F.sin(angle).alias("time_sin"),
                         F.cos(angle).alias("time_cos"), *type_one_hot(F.col("device_type")))
