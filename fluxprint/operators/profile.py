"""Frozen behaviour profile of every device, as tidy tables built in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxprint.functions import stats
from fluxprint.functions.scalars import port_key
from fluxprint.schemas import BASELINE_FEATURES, LINEAR_FEATURES

# Width of a normal distribution's interquartile range in sigmas,
# and how many sigmas from the median a window may lie.
IQR_PER_SIGMA = 1.349
TRIM_SIGMAS = 3


def unpivot(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """One row per observed feature value; NULL means not observed and is dropped."""
    doubles = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(keys), list(columns), name, value).filter(F.col(value).isNotNull())


# D9
def robust_stats(windows: DataFrame, features: Sequence[str] = tuple(BASELINE_FEATURES),
                 linear: Sequence[str] = tuple(LINEAR_FEATURES), key: str = "device") -> DataFrame:
    """Trimmed location and spread per device and feature.

    A group holds one value per window of one device, so it is bounded by time,
    not by traffic; features are unpivoted so that all share one pass.
    """
    long = unpivot(windows, [key], features)
    grid = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    first = long.groupBy(key, "feature").agg(
        F.count(F.lit(1)).alias("windows_observed"), F.min("value").alias("_min"),
        F.percentile("value", grid).alias("_plain"),
        F.percentile(F.log1p(F.greatest("value", F.lit(0.0))), grid).alias("_log"))
    use_log = ~F.col("feature").isin(list(linear)) & (F.col("_min") >= 0)
    q = F.when(use_log, F.col("_log")).otherwise(F.col("_plain"))
    sigma = (q[2] - q[0]) / F.lit(IQR_PER_SIGMA)
    bounds = first.select(
        key, "feature", "windows_observed", use_log.alias("_use_log"),
        F.when(sigma > 0, q[1] - TRIM_SIGMAS * sigma).alias("_low"),
        F.when(sigma > 0, q[1] + TRIM_SIGMAS * sigma).alias("_high"))
    space = F.when(F.col("_use_log"), F.log1p("value")).otherwise(F.col("value"))
    kept = long.join(bounds, [key, "feature"]).filter(
        F.col("_low").isNull() | space.between(F.col("_low"), F.col("_high")))
    n = F.col("group_n")
    own = [F.first(c).alias(c) for c in ("windows_observed", "_use_log", "_low", "_high")]
    summary = stats.ranked(kept, [key, "feature"], "value").groupBy(key, "feature").agg(
        F.percentile("value", grid).alias("_k"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        stats.at_rank("value", stats.nearest_rank(n, 0.95)).alias("p95"),
        stats.at_rank("value", stats.nearest_rank(n, 0.99)).alias("p99"),
        F.count(F.lit(1)).alias("_kept"), *own)

    def unit(c: str):
        return F.when(F.col("_use_log"), F.expm1(c)).otherwise(F.col(c))

    return summary.select(
        key, "feature", F.col("_k")[1].alias("median"), F.col("_k")[0].alias("q1"), F.col("_k")[2].alias("q3"),
        (F.col("_k")[2] - F.col("_k")[0]).alias("iqr"), "mean", "min", "max", "p95", "p99", "windows_observed",
        (F.col("windows_observed") - F.col("_kept")).alias("windows_excluded"),
        unit("_low").alias("low_bound"), unit("_high").alias("high_bound"),
        F.when(F.col("_use_log"), "log1p").otherwise("linear").alias("trim_space"))


# D10
def service_summary(windows: DataFrame, shares: DataFrame, key: str = "device") -> DataFrame:
    """Mean share over all windows of the device, with or without the service."""
    per_device = windows.groupBy(key).agg(F.count(F.lit(1)).alias("_windows"))
    per_service = shares.groupBy(key, "service").agg(
        F.sum("share").alias("_share"), F.count(F.lit(1)).alias("windows_present"))
    return per_service.join(per_device, key).select(
        key, "service", (F.col("_share") / F.col("_windows")).alias("mean_share"), "windows_present",
        (F.col("windows_present") / F.col("_windows")).alias("window_share"))


# D11
def active_hours(windows: DataFrame, key: str = "device") -> DataFrame:
    """24 rows per device, silent hours included; one aggregate, then arithmetic."""
    hours = range(24)
    wide = windows.groupBy(key).agg(
        *[F.sum(F.when(F.col("hour_of_day") == h, F.col("flow_count"))).alias(f"_f{h}") for h in hours],
        *[F.count_if(F.col("hour_of_day") == h).alias(f"_w{h}") for h in hours],
        F.sum("flow_count").alias("_flows"), F.count(F.lit(1)).alias("_windows"))
    rows = wide.select(key, "_flows", "_windows", F.explode(F.array(*[
        F.struct(F.lit(h).alias("hour"), F.coalesce(f"_f{h}", F.lit(0)).alias("flows"), F.col(f"_w{h}").alias("windows"))
        for h in hours])).alias("h"))
    return rows.select(
        key, "h.hour", "h.flows", (F.col("h.flows") / F.greatest("_flows", F.lit(1))).alias("flow_share"),
        "h.windows", (F.col("h.windows") / F.greatest("_windows", F.lit(1))).alias("window_share"))


# D12
def endpoint_counts(flows: DataFrame, dns: DataFrame, tls_names: DataFrame | None = None) -> DataFrame:
    """Allow-list ``(device, kind, value, n)`` in both directions.

    ``flows`` carries ``device`` and ``initiated``: False marks a flow that
    another host opened towards the device.
    """
    port = port_key(F.col("proto"), F.col("resp_p"))
    both = flows.select("device", F.explode(F.array(
        F.struct(F.when(F.col("initiated"), "destination_ips").otherwise("source_ips").alias("kind"),
                 F.when(F.col("initiated"), F.col("resp_h")).otherwise(F.col("orig_h")).alias("value")),
        F.struct(F.when(F.col("initiated"), "destination_ports").otherwise("listening_ports").alias("kind"),
                 port.alias("value")))).alias("e")).select("device", "e.kind", "e.value")
    names = dns.select("device", F.lit("domains").alias("kind"), F.col("query").alias("value"))
    if tls_names is not None:
        names = names.unionByName(tls_names.select("device", F.lit("tls_server_names").alias("kind"),
                                                   F.col("name").alias("value")))
    return (both.unionByName(names).filter(F.col("value").isNotNull() & (F.col("value") != ""))
            .groupBy("device", "kind", "value").agg(F.count(F.lit(1)).alias("n")))


def endpoint_totals(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("device", "kind").agg(F.count(F.lit(1)).alias("distinct_values"),
                                                   F.sum("n").alias("rows"))


# D13
def observation_summary(windows: DataFrame, key: str = "device") -> DataFrame:
    first, last = F.min("window_start"), F.max("window_start")
    return windows.groupBy(key).agg(
        F.count(F.lit(1)).alias("active_windows"), F.sum("flow_count").alias("flows"),
        first.alias("first_window"), last.alias("last_window"), ((last - first) / 86400).alias("span_days"))


# D15
@dataclass(frozen=True)
class Profile:
    """The frozen profile of all devices; each table is keyed by ``device``."""

    observation: DataFrame
    stats: DataFrame
    services: DataFrame
    hours: DataFrame
    endpoints: DataFrame
    calibration: DataFrame | None = None
    baseline_scores: DataFrame | None = None


def build_profile(windows: DataFrame, shares: DataFrame, endpoints: DataFrame) -> Profile:
    return Profile(observation_summary(windows), robust_stats(windows), service_summary(windows, shares),
                   active_hours(windows), endpoints)
