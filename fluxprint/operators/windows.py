"""Behaviour windows: one row per device and window, endpoint sets kept long."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.functions import ordered, stats
from fluxprint.functions.scalars import bucket_start, port_key, utc_hour
from fluxprint.schemas import FAILED_STATES

KEYS = ["device", "window_start"]


# B2, B3
def with_window(rows: DataFrame, window: int) -> DataFrame:
    return rows.filter(F.col("ts").isNotNull()).withColumn("window_start", bucket_start(F.col("ts"), window))


# D1, D5
def volume_features(flows: DataFrame, window: int) -> DataFrame:
    """Counts and sums; the one distinct count is planned without row expansion."""
    tcp = F.col("proto") == "tcp"
    failed = tcp & F.col("conn_state").isin(FAILED_STATES)
    zero = F.lit(0)
    return with_window(flows, window).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.count_distinct(F.when(F.col("resp_h") != "", F.col("resp_h"))).alias("unique_destinations"),
        F.sum(F.coalesce("orig_bytes", zero)).alias("orig_bytes"),
        F.sum(F.coalesce("resp_bytes", zero)).alias("resp_bytes"),
        (F.sum(F.coalesce("orig_pkts", zero)) + F.sum(F.coalesce("resp_pkts", zero))).alias("packets_total"),
        stats.ratio(F.count_if(failed), F.count_if(tcp)).alias("tcp_failed_ratio"),
    ).withColumn("bytes_total", F.col("orig_bytes") + F.col("resp_bytes"))


# D2
def domain_features(dns: DataFrame, window: int) -> DataFrame:
    per_name = with_window(dns, window).groupBy(*KEYS, "query").agg(F.count(F.lit(1)).alias("n"))
    return per_name.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("unique_domains"),
                                       stats.entropy_of_counts(F.col("n")).alias("domain_entropy"))


# D3
def service_shares(flows: DataFrame, window: int) -> DataFrame:
    """Long form of the service mix: share of each label in its window."""
    label = F.coalesce(F.when(F.col("service") != "", F.col("service")), F.lit("unknown"))
    counted = (with_window(flows, window).groupBy(*KEYS, label.alias("service"))
               .agg(F.count(F.lit(1)).alias("flows")))
    total = F.sum("flows").over(Window.partitionBy(*KEYS))
    return counted.withColumn("share", F.col("flows") / total)


def service_map(shares: DataFrame) -> DataFrame:
    """The mix as one map per window; its size is the number of service labels."""
    return shares.groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("service", "share")))).alias("service_distribution"))


# D4
def gap_variance(flows: DataFrame, window: int) -> DataFrame:
    gaps = ordered.gap_moments(with_window(flows, window).select(*KEYS, "ts"), KEYS, "ts", window / 60)
    return gaps.select(*KEYS, F.col("gap_variance").alias("interflow_gap_variance"))


# D6
def behaviour_windows(flows: DataFrame, dns: DataFrame, window: int) -> DataFrame:
    """All numeric features; a window with only one of the two logs still appears.

    Every input arrives hashed by ``(device, window_start)`` from its own
    aggregate, so the two joins add no shuffle.
    """
    volume = volume_features(flows, window)
    joined = volume.join(domain_features(dns, window), KEYS, "full").join(gap_variance(flows, window), KEYS, "left")
    counts = ["flow_count", "unique_destinations", "unique_domains", "bytes_total", "orig_bytes", "resp_bytes",
              "packets_total"]
    return joined.select(
        *KEYS, F.lit(window).alias("window_seconds"), utc_hour(F.col("window_start")).alias("hour_of_day"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("domain_entropy", F.lit(0.0)).alias("domain_entropy"),
        "interflow_gap_variance", "tcp_failed_ratio")


def window_endpoints(flows: DataFrame, dns: DataFrame, window: int) -> DataFrame:
    """Distinct ``(device, window_start, kind, value)`` of destinations, ports and domains."""
    seen = with_window(flows, window).select(
        *KEYS, F.explode(F.array(
            F.struct(F.lit("destination").alias("kind"), F.col("resp_h").alias("value")),
            F.struct(F.lit("port").alias("kind"), port_key(F.col("proto"), F.col("resp_p")).alias("value")))).alias("e"))
    names = with_window(dns, window).select(*KEYS, F.lit("domain").alias("kind"), F.col("query").alias("value"))
    return (seen.select(*KEYS, "e.kind", "e.value").unionByName(names)
            .filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct())
