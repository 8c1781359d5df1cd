"""Traffic statistics per device from raw flow files; groups here have no bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.functions import ordered, stats
from fluxprint.functions.scalars import epoch_unit_factor
from fluxprint.operators.profile import unpivot

# Floors and ceilings of a usable day, and the share of flows from
# which an hour counts as active.
MIN_FLOWS_PER_DAY = 50
MIN_RELATIVE_FRACTION = 0.2
MAX_SINGLE_HOUR_SHARE = 0.5
ACTIVE_SHARE = 1.0 / 48
FLAT_DEVIATION = 0.02


# B14
def epoch_seconds(rows: DataFrame, column: str, file: str = "file") -> DataFrame:
    """Seconds from an epoch column whose unit each file's median tells."""
    middle = stats.quantiles(rows, [file], column, {"_median": 0.5})
    factor = middle.select(file, epoch_unit_factor(F.col("_median")).alias("_factor"))
    return rows.join(factor, file, "left").withColumn("ts", F.col(column) * F.col("_factor")).drop("_factor")


# J2
def numeric_summary(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Moments from one partial aggregate, quartiles from distributed ranks."""
    long = unpivot(rows, keys, columns)
    group = [*keys, "feature"]
    moments = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("value")).otherwise(0.0).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = stats.quantiles(long, group, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    return moments.join(q, group).withColumn("iqr", F.col("q3") - F.col("q1"))


# J3
def value_shares(rows: DataFrame, keys: Sequence[str], column: str, top: int | None = None) -> DataFrame:
    """Normalised counts; equal counts are ordered by value."""
    counted = (rows.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("string").alias("value"))
               .agg(F.count(F.lit(1)).alias("n")))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    if top is not None:
        counted = ordered.top_per_group(counted, keys, [F.desc("n"), F.col("value")], top).drop("position")
    return counted.join(totals, list(keys)).select(*keys, "value", "n", (F.col("n") / F.col("_total")).alias("share"))


# J4
def destination_summary(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Distinct destinations, and the share of flows to those met only once."""
    counted = rows.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_destinations"), F.sum("n").alias("flows"),
        (F.count_if(F.col("n") == 1) / F.sum("n")).alias("singleton_share"))


def day_hours(rows: DataFrame, device: str = "device", day: str = "day", hour: str = "hour") -> DataFrame:
    """One row per device-day with flows, 24 hour counts, and the device's typical day."""
    per_hour = rows.groupBy(device, day, hour).agg(F.count(F.lit(1)).alias("n"))
    days = per_hour.groupBy(device, day).agg(
        F.sum("n").alias("flows"), F.max("n").alias("peak"),
        *[F.coalesce(F.max(F.when(F.col(hour) == h, F.col("n"))), F.lit(0)).alias(f"h{h}") for h in range(24)])
    # days of one device: bounded by the calendar
    middle = days.groupBy(device).agg(F.percentile("flows", 0.5).alias("median_daily_flows"))
    return days.join(middle, device)


def day_issue() -> tuple[Column, Column, Column]:
    few = F.col("flows") < MIN_FLOWS_PER_DAY
    sparse = F.col("flows") < MIN_RELATIVE_FRACTION * F.col("median_daily_flows")
    return few, sparse, F.col("peak") / F.col("flows") > MAX_SINGLE_HOUR_SHARE


# J5
def robust_active_hours(days: DataFrame, device: str = "device") -> DataFrame:
    """Median hourly share over the usable days; 24 rows per device that has any."""
    few, sparse, peaked = day_issue()
    used = days.filter(~(few | sparse | peaked))
    wide = used.groupBy(device).agg(
        F.count(F.lit(1)).alias("days_used"), *[F.percentile(F.col(f"h{h}") / F.col("flows"), 0.5).alias(f"m{h}") for h in range(24)])
    return wide.select(device, "days_used", F.explode(F.array(*[
        F.struct(F.lit(h).alias("hour"), F.col(f"m{h}").alias("share")) for h in range(24)])).alias("h")).select(
        device, "days_used", "h.hour", "h.share", (F.col("h.share") >= ACTIVE_SHARE).alias("active"))


# J6
def day_quality(days: DataFrame, device: str = "device", day: str = "day") -> DataFrame:
    few, sparse, peaked = day_issue()
    deviation = F.greatest(*[F.abs(F.col(f"h{h}") / F.col("flows") - F.lit(1.0 / 24)) for h in range(24)])
    volume = F.when(few, "low_flow_count").when(sparse, "low_relative_to_median")
    shape = F.when(peaked, "concentrated_in_one_hour")
    issues = F.concat_ws(";", volume, shape)
    status = F.when(issues != "", issues).when(deviation < FLAT_DEVIATION, "flat").otherwise("peaked")
    return days.select(device, day, "flows", (F.col("peak") / F.col("flows")).alias("peak_share"), status.alias("status"))
