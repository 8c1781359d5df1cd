"""Data quality rules as rows ``(rule, key, ...)``, with a strict form that fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.functions.scalars import ipv4_number, network_parts, valid_ip
from fluxprint.operators.identity import contested
from fluxprint.operators.residuals import union_all, violations
from fluxprint.schemas import DEVICE_TYPES


def strict(checked: DataFrame) -> None:
    """Fail on the first violation; reads no further than one row."""
    bad = checked.limit(1).collect()
    if bad:
        raise ValueError(f"validation failed: {bad[0].asDict()}")


# L1
def telemetry_rules(window: int) -> list[tuple[str, Column]]:
    counters = ["orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "resp_pkts"]
    needed = ["window_start", "uid", "orig_h", "resp_h", "proto", "flow_start", *counters, "observed_duration",
              "established", "failed", "new_flow"]
    c = F.col

    def finite(name: str) -> Column:
        return ~F.isnan(name) & (F.abs(c(name)) != float("inf"))

    return [
        *[(f"missing_{n}", c(n).isNull()) for n in needed],
        ("unaligned_window", F.pmod(c("window_start"), F.lit(window)) != 0), ("empty_uid", c("uid") == ""),
        ("invalid_flow_start", ~finite("flow_start")), ("future_flow_start", c("flow_start") >= c("window_start") + window),
        *[(f"invalid_{n}", c(n).isNotNull() & ~valid_ip(c(n))) for n in ("orig_h", "resp_h")],
        *[(f"negative_{n}", c(n) < 0) for n in counters],
        ("invalid_observed_duration", (c("observed_duration") < 0) | ~finite("observed_duration")),
        *[(f"invalid_{n}", ~c(n).between(0, 65535)) for n in ("orig_p", "resp_p")],
        ("failed_and_established", c("failed") & c("established")),
        ("failed_without_syn", c("failed") & ~c("tcp_syn_observed")),
    ]


def telemetry(rows: DataFrame, window: int = 60, keys: Sequence[str] = ("uid", "window_start")) -> DataFrame:
    """All per-row rules in one pass, without a shuffle."""
    return violations(rows, keys, telemetry_rules(window))


# L2
def inventory(devices: DataFrame, leases: DataFrame, start: int, end: int, window: int) -> DataFrame:
    repeated = devices.groupBy("device").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "device", F.lit("duplicate_device").alias("rule"))
    has_lease = leases.select("device").distinct().withColumn("_lease", F.lit(True))
    own = violations(devices.join(has_lease, "device", "left"), ["device"], [
        ("unknown_type", ~F.col("device_type").isin(DEVICE_TYPES)),
        ("no_identity", F.coalesce(F.col("mac") == "", F.lit(True)) & F.col("_lease").isNull())])
    lease = violations(leases, ["device"], [
        ("invalid_lease", F.coalesce("lease_end", F.lit(end)) <= F.coalesce("lease_start", F.lit(start))),
        ("invalid_lease_ip", ~valid_ip(F.col("ip")))])
    if start % window or end % window or end <= start:
        bounds = devices.limit(1).select(F.lit(None).cast("string").alias("device"), F.lit("invalid_bounds").alias("rule"))
        return union_all([repeated, own, lease, bounds])
    return union_all([repeated, own, lease])


def training_manifest(manifests: DataFrame) -> DataFrame:
    """Rules a capture must meet before its profile may be frozen."""
    return violations(manifests, ["run_id"], [
        ("incomplete_capture", ~F.coalesce("capture_complete", F.lit(False))),
        ("accelerated_replay", F.coalesce("replay_speed", F.lit(0)) != 1),
        ("capture_drops", F.coalesce("capture_drops", F.lit(0)) != 0)])


# L3
def labels(rows: DataFrame, devices: DataFrame, start: int, end: int, intervals: DataFrame | None = None) -> DataFrame:
    known = devices.select("device").distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, "device", "left")
    positive = F.col("label") == 1
    own = violations(joined, ["label_id", "device"], [
        ("unknown_device", F.col("_known").isNull()), ("label_not_binary", ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))),
        ("invalid_interval", F.coalesce(F.col("start") >= F.col("end"), F.lit(True))),
        ("outside_capture", (F.col("start") < start) | (F.col("end") > end)),
        ("no_evidence", F.coalesce(F.col("evidence") == "", F.lit(True))),
        ("positive_not_actor", positive & ~F.coalesce(F.col("role") == "actor", F.lit(False))),
        ("positive_without_family", positive & F.coalesce(F.col("attack_family") == "", F.lit(True))),
        ("positive_without_onset", positive & ~F.coalesce(F.col("onset").isin("from_start", "later"), F.lit(False)))])
    if intervals is None:
        return own
    nested = intervals.select("label_id", F.col("start").alias("_s"), F.col("end").alias("_e")).join(
        rows.select("label_id", "device", "start", "end"), "label_id")
    return union_all([own, violations(nested, ["label_id", "device"], [
        ("interval_outside_label", (F.col("_s") < F.col("start")) | (F.col("_e") > F.col("end")) | (F.col("_s") >= F.col("_e")))])])


# L4
def windows(rows: DataFrame, now: float, skew: float = 2.0, window: int = 60) -> DataFrame:
    """Envelope rules of closed windows."""
    length = F.col("window_end") - F.col("window_start")
    return violations(rows, ["sensor_id", "window_start"], [
        ("wrong_length", length != window), ("not_closed", F.col("window_end") > now + skew),
        ("complete_without_watermark", F.col("complete") & (F.col("watermark") < F.col("window_end")))])


def repeated(rows: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that occur more than once; counts are combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit(rule).alias("rule"))


def ambiguous_ownership(leases: DataFrame) -> DataFrame:
    """Times at which two devices hold one address."""
    return contested(leases, ["ip"], "device", "lease_start", "lease_end").select(
        "ip", F.col("_s").alias("from"), F.col("_e").alias("until"), F.lit("ambiguous_ip_ownership").alias("rule"))


# L5
def bindings(rows: DataFrame, network: str) -> DataFrame:
    """Bindings that are malformed, overlap within a device, or share a resource.

    ``rows`` has ``binding_id, device, ip, mac, switch_port, valid_from, valid_until``.
    """
    base, bits = network_parts(F.lit(network))
    number = ipv4_number(F.col("ip"))
    span = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    own = violations(rows, ["device"], [
        ("invalid_interval", F.col("valid_until") <= F.col("valid_from")),
        ("outside_subnet", ~F.coalesce((number >= base) & (number < base + span), F.lit(False))),
        ("invalid_switch_port", F.col("switch_port") <= 0)])
    good = rows.filter(F.col("valid_until").isNull() | (F.col("valid_until") > F.col("valid_from")))
    within = contested(good, ["device"], "binding_id", "valid_from", "valid_until").select(
        "device", F.lit("overlapping_bindings").alias("rule")).distinct()
    shared = [contested(good, [c], "device", "valid_from", "valid_until").select(
        F.lit(None).cast("string").alias("device"), F.col(c).cast("string").alias("resource"),
        F.lit(f"shared_{c}").alias("rule")).distinct() for c in ("ip", "mac", "switch_port")]
    return union_all([own, within, *shared])


# L6
def policy(permissions: DataFrame, external: DataFrame, devices: DataFrame) -> DataFrame:
    key = ["initiator", "responder", "proto", "service_port"]
    twice = repeated(permissions, key, "duplicate_permission").select("initiator", "rule")
    known = devices.select(F.col("device").alias("initiator")).distinct().withColumn("_known", F.lit(True))
    has_net = F.coalesce(F.col("network") != "", F.lit(False))
    has_name = F.coalesce(F.col("fqdn") != "", F.lit(False))
    own = violations(external.join(known, "initiator", "left"), ["initiator"], [
        ("unknown_initiator", F.col("_known").isNull()), ("invalid_protocol", ~F.coalesce(F.col("proto").isin("tcp", "udp"), F.lit(False))),
        ("invalid_port", ~F.coalesce(F.col("service_port").between(1, 65535), F.lit(False))),
        ("network_or_name_required", has_net == has_name)])
    return twice.unionByName(own)


# L7
def flow_profile(counts: DataFrame, totals: DataFrame, normaliser: DataFrame | None = None) -> DataFrame:
    """Counts must be non-negative and add up to their group's total; spreads positive."""
    sums = counts.groupBy("device", "direction").agg(F.sum("seen").alias("_sum"), F.min("seen").alias("_least"))
    both = totals.join(sums, ["device", "direction"], "full")
    own = violations(both, ["device", "direction"], [
        ("negative_count", F.col("_least") < 0), ("invalid_total", F.coalesce(F.col("total") < 0, F.lit(True))),
        ("counts_do_not_sum", F.coalesce("_sum", F.lit(0)) != F.coalesce("total", F.lit(0)))])
    if normaliser is None:
        return own
    spreads = [c for c in normaliser.columns if c.startswith("std_")]
    bad = violations(normaliser, ["device_type"], [(f"invalid_{c}", ~F.coalesce((F.col(c) > 0) & ~F.isnan(c), F.lit(False)))
                                                  for c in spreads])
    return union_all([own, bad])


# L8
def causality(history: DataFrame, current: str = "window_start", prior: str = "prior_start",
              run: str = "run_id", prior_run: str = "prior_run_id", keys: Sequence[str] = ("device",)) -> DataFrame:
    """History entries (long) must be earlier, distinct and of the same run."""
    own = violations(history, [*keys, current], [
        ("future_history", F.col(prior) >= F.col(current)), ("other_run", ~F.col(run).eqNullSafe(F.col(prior_run)))])
    twice = repeated(history, [*keys, current, prior], "duplicate_history").select(*keys, current, "rule")
    return own.unionByName(twice)


# L9
def interval_rows(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Repeated ``(uid, window_start)`` and rows outside the capture."""
    twice = repeated(rows, ["uid", "window_start"], "duplicate_interval")
    outside = violations(rows, ["uid", "window_start"], [
        ("before_capture", F.col("window_start") < start), ("after_capture", F.col("window_start") >= end)])
    return twice.unionByName(outside)
