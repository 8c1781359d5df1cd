"""Explainable deviation of windows from a frozen profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.functions import ordered, stats
from fluxprint.functions.scalars import clip
from fluxprint.operators.profile import IQR_PER_SIGMA, Profile
from fluxprint.schemas import COMPONENTS

KEYS = ["device", "window_start"]

# Robust z that scores one half, and the highest calibrated
# ceiling, which leaves every component some headroom.
HALF_SCORE_Z = 6.0
MAX_CEILING = 0.99

# Numeric components, the feature behind each, and the profile
# kinds that make up the known set of each endpoint component.
NUMERIC_COMPONENTS = {"volume": "bytes_total", "flow_rate": "flow_count"}
KNOWN_KINDS = {
    "destination": ["destination_ips"],
    "domain": ["domains", "tls_server_names"],
    "port": ["destination_ports", "listening_ports"],
}
UNSEEN_COMPONENTS = {"new_destinations": "destination", "new_domains": "domain", "new_ports": "port"}


# C14
def unseen_endpoints(window_endpoints: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Each distinct window endpoint, flagged when the profile never saw it."""
    kind = reduce(lambda acc, item: acc.when(F.col("kind").isin(item[1]), item[0]), KNOWN_KINDS.items(),
                  F.when(F.lit(False), F.lit(None).cast("string")))
    known = endpoints.select("device", kind.alias("kind"), "value").filter("kind is not null").distinct()
    return (window_endpoints.join(known.withColumn("_known", F.lit(True)), ["device", "kind", "value"], "left")
            .select(*KEYS, "kind", "value", F.col("_known").isNull().alias("unseen")))


def unseen_shares(flagged: DataFrame) -> DataFrame:
    def share(kind: str) -> Column:
        mine = F.col("kind") == kind
        return F.coalesce(stats.ratio(F.count_if(mine & F.col("unseen")), F.count_if(mine)), F.lit(0.0))

    return flagged.groupBy(*KEYS).agg(*[share(kind).alias(c) for c, kind in UNSEEN_COMPONENTS.items()])


def unseen_evidence(flagged: DataFrame, k: int = 20) -> DataFrame:
    """At most ``k`` unseen values per window and kind, the first in text order."""
    top = ordered.top_per_group(flagged.filter("unseen"), [*KEYS, "kind"], [F.col("value")], k)
    return top.groupBy(*KEYS, "kind").agg(F.array_sort(F.collect_list("value")).alias("evidence"))


# E1
def robust_z(value: Column, prefix: str) -> Column:
    """One-sided robust z against ``{prefix}_median`` and its companions."""
    def stat(name: str) -> Column:
        return F.col(f"{prefix}_{name}")

    in_log = (stat("trim_space") == "log1p") & (value >= 0)

    def move(c: Column) -> Column:
        return F.when(in_log, F.log1p(c)).otherwise(c)

    now, middle, top = move(value), move(stat("median")), move(stat("max"))
    spread = (move(stat("q3")) - move(stat("q1"))) / F.lit(IQR_PER_SIGMA)
    flat = F.when((now <= top) | (top <= 0), 0.0).otherwise(HALF_SCORE_Z * now / top)
    z = F.when(now <= middle, 0.0).when(spread <= 0, flat).otherwise((now - middle) / spread)
    return F.when(value.isNull() | stat("median").isNull(), 0.0).otherwise(z)


# E2
def squash(z: Column) -> Column:
    return F.when(z > 0, z / (z + HALF_SCORE_Z)).otherwise(0.0)


# E3
def service_drift(windows: DataFrame, shares: DataFrame, services: DataFrame) -> DataFrame:
    """Total variation distance between a window's service mix and the baseline's.

    The baseline is normalised to one, so services that a window lacks need no
    row of their own: ``sum|c-b|`` over all is ``1 + sum(|c-b| - b)`` over those
    the window has. A left join then replaces a full outer one. Rounding to 12
    digits keeps the order of a sum from making a tiny excess over a ceiling.
    """
    total = services.groupBy("device").agg(F.sum("mean_share").alias("_total"))
    base = services.join(total, "device").select(
        "device", "service", (F.col("mean_share") / F.col("_total")).alias("_b"))
    b = F.coalesce("_b", F.lit(0.0))
    part = (shares.join(base, ["device", "service"], "left").groupBy(*KEYS)
            .agg(F.sum(F.abs(F.col("share") - b) - b).alias("_part")))
    drift = F.lit(0.5) * (1 + F.coalesce("_part", F.lit(0.0)))
    return (windows.select(*KEYS).join(part, KEYS, "left").join(total, "device", "left")
            .select(*KEYS, F.when(F.col("_total") > 0, F.round(drift, 12)).otherwise(0.0).alias("protocol_drift")))


# E4
def failed_excess(value: Column, prefix: str = "tcp_failed_ratio") -> Column:
    ceiling = F.col(f"{prefix}_p99")
    excess = clip((value - ceiling) / (1 - ceiling), 0.0, 1.0)
    return F.when((value > ceiling) & (ceiling < 1), excess).otherwise(0.0)


def wide_stats(stats_table: DataFrame, features: list[str]) -> DataFrame:
    """One row per device with ``{feature}_{statistic}`` columns."""
    names = ["median", "q1", "q3", "max", "p99", "trim_space"]
    return stats_table.filter(F.col("feature").isin(features)).groupBy("device").agg(*[
        F.max(F.when(F.col("feature") == f, F.col(n))).alias(f"{f}_{n}") for f in features for n in names])


# E5
def raw_components(profile: Profile, windows: DataFrame, shares: DataFrame, window_endpoints: DataFrame) -> DataFrame:
    features = [*NUMERIC_COMPONENTS.values(), "tcp_failed_ratio"]
    unseen = unseen_shares(unseen_endpoints(window_endpoints, profile.endpoints))
    drift = service_drift(windows, shares, profile.services)
    joined = (windows.join(unseen, KEYS, "left").join(drift, KEYS, "left")
              .join(wide_stats(profile.stats, features), "device", "left"))
    return joined.select(
        *KEYS, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in UNSEEN_COMPONENTS], "protocol_drift",
        failed_excess(F.col("tcp_failed_ratio")).alias("failed_conns"),
        *[squash(robust_z(F.col(f), f)).alias(c) for c, f in NUMERIC_COMPONENTS.items()])


# E6
def calibrated(value: Column, ceiling: Column) -> Column:
    c = F.least(F.coalesce(ceiling, F.lit(0.0)), F.lit(MAX_CEILING))
    return clip((value - c) / (1 - c), 0.0, 1.0)


# E7
def noisy_or(values: list[Column]) -> Column:
    return 1 - reduce(lambda acc, v: acc * (1 - v), values, F.lit(1.0))


# E8
def top_component(names: list[str]) -> Column:
    """First maximum in component order, NULL when everything is zero."""
    highest = F.greatest(*[F.col(n) for n in names])
    chain = reduce(lambda acc, n: acc.when(F.col(n) == highest, n), names, F.when(highest <= 0, F.lit(None)))
    return chain


# D14
def component_calibration(raw: DataFrame) -> DataFrame:
    """p50, p95 and p99 of every component over the training windows."""
    long = raw.unpivot(["device"], COMPONENTS, "component", "value")
    return stats.percentiles_nearest(long, ["device", "component"], "value",
                                     {"p50": 0.50, "p95": 0.95, "p99": 0.99}).drop("max", "n")


def apply_calibration(raw: DataFrame, calibration: DataFrame | None) -> DataFrame:
    """Raw components rescaled against the profile's own, then combined."""
    if calibration is None:
        scaled = raw.withColumn("calibrated", F.lit(False))
    else:
        wide = calibration.groupBy("device").agg(*[
            F.max(F.when(F.col("component") == c, F.col("p99"))).alias("_p99_" + c) for c in COMPONENTS])
        joined = raw.join(wide.withColumn("_has", F.lit(True)), "device", "left")
        scaled = joined.select(*KEYS, *[
            F.when(F.col("_has"), calibrated(F.col(c), F.col("_p99_" + c))).otherwise(F.col(c)).alias(c)
            for c in COMPONENTS], F.coalesce("_has", F.lit(False)).alias("calibrated"))
    return (scaled.withColumn("deviation_score", noisy_or([F.col(c) for c in COMPONENTS]))
            .withColumn("top_component", top_component(COMPONENTS)))


def baseline_scores(scored: DataFrame) -> DataFrame:
    return stats.percentiles_nearest(scored, ["device"], "deviation_score",
                                     {"p50": 0.50, "p95": 0.95, "p99": 0.99}).withColumnRenamed("n", "windows")


def fit_and_score(profile: Profile, windows: DataFrame, shares: DataFrame, window_endpoints: DataFrame,
                  is_training: Column, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
                  ) -> tuple[Profile, DataFrame]:
    """Calibrate on the training windows and score every window.

    Both need the raw components, so these are computed once for all windows;
    ``keep`` may store them.
    """
    raw = keep(raw_components(profile, windows, shares, window_endpoints), "raw-components")
    table = component_calibration(raw.filter(is_training))
    scored = apply_calibration(raw, table)
    return replace(profile, calibration=table, baseline_scores=baseline_scores(scored.filter(is_training))), scored


def score_windows(profile: Profile, windows: DataFrame, shares: DataFrame, window_endpoints: DataFrame) -> DataFrame:
    return apply_calibration(raw_components(profile, windows, shares, window_endpoints), profile.calibration)


# E9
def score_summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per device: middle element, truncated-rank p99, maximum, flagged share."""
    n = F.col("group_n")
    flagged = F.count_if(F.col("deviation_score") > threshold)
    return stats.ranked(scored, ["device"], "deviation_score").groupBy("device").agg(
        F.count(F.lit(1)).alias("windows"),
        stats.at_rank("deviation_score", F.floor(n / 2)).alias("median"),
        stats.at_rank("deviation_score", stats.nearest_rank(n, 0.99, "truncate")).alias("p99"),
        F.max("deviation_score").alias("max"), flagged.alias("flagged"),
        (flagged / F.count(F.lit(1))).alias("flagged_share"))


def top_windows(scored: DataFrame, k: int = 5) -> DataFrame:
    return ordered.top_per_group(scored, ["device"], [F.desc("deviation_score"), F.col("window_start")], k)


# E10
# What each injected change overwrites in a typical window and
# the components that it is meant to trip.
SCENARIOS = {
    "port_scan": {
        "destinations": [f"10.0.0.{n}" for n in range(20, 60)],
        "ports": ["tcp/22", "tcp/23", "tcp/80", "tcp/443", "tcp/445", "tcp/8080"],
        "numbers": {"flow_count": 40.0, "tcp_failed_ratio": 0.95}, "services": {"unknown": 1.0},
        "expected": ["new_destinations", "failed_conns"],
    },
    "lateral_movement": {
        "destinations": ["10.0.0.11", "10.0.0.12", "10.0.0.13"], "ports": ["tcp/22", "tcp/445"],
        "numbers": {"flow_count": 6.0, "tcp_failed_ratio": 0.5},
        "expected": ["new_destinations", "new_ports"],
    },
    "exfiltration": {
        "destinations": ["203.0.113.47"], "numbers": {"bytes_total": 500_000_000.0}, "expected": ["volume"],
    },
    "c2_beacon": {
        "destinations": ["198.51.100.23"], "domains": ["cdn-update-service.example.net"],
        "numbers": {"flow_count": 2.0, "bytes_total": 320.0}, "expected": ["new_domains", "new_destinations"],
    },
}


def typical_windows(windows: DataFrame) -> DataFrame:
    """Per device the earliest window whose flow count is closest to the median."""
    middle = windows.groupBy("device").agg(F.percentile("flow_count", 0.5).alias("_median"))
    distance = F.abs(F.col("flow_count") - F.col("_median"))
    picked = windows.join(middle, "device").groupBy("device").agg(
        F.min_by("window_start", F.struct(distance, F.col("window_start"))).alias("window_start"))
    return windows.join(picked, KEYS, "left_semi")


def injected_changes(typical: DataFrame, shares: DataFrame, window_endpoints: DataFrame,
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The typical windows under every scenario, as the scorer's three inputs.

    A scenario is told apart by its device key ``device|scenario``; profiles are
    matched to it by :func:`for_scenarios`.
    """
    names = F.array(*[F.lit(s) for s in SCENARIOS])
    tagged = typical.withColumn("scenario", F.explode(names))
    scenario = F.col("scenario")

    def replaced(feature: str) -> Column:
        pairs = {s: spec["numbers"][feature] for s, spec in SCENARIOS.items() if feature in spec["numbers"]}
        out = F.col(feature).cast("double")
        for s, v in pairs.items():
            out = F.when(scenario == s, F.lit(v)).otherwise(out)
        return out.alias(feature)

    changed = ["flow_count", "tcp_failed_ratio", "bytes_total"]
    windows = tagged.select(*KEYS, "scenario", *[replaced(f) for f in changed])

    def own(rows: DataFrame) -> DataFrame:
        return rows.join(typical.select(*KEYS), KEYS, "left_semi").withColumn("scenario", F.explode(names))

    plural = {"destination": "destinations", "port": "ports", "domain": "domains"}
    keep = reduce(lambda acc, item: acc & ~((F.col("kind") == item[0]) & scenario.isin(
        [s for s, spec in SCENARIOS.items() if item[1] in spec])), plural.items(), F.lit(True))
    planted = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(kind).alias("kind"), F.lit(v).alias("value"))
                        for s, spec in SCENARIOS.items() for kind, field in plural.items()
                        for v in spec.get(field, [])])
    new = typical.select(*KEYS, F.explode(planted).alias("p")).select(*KEYS, "p.scenario", "p.kind", "p.value")
    endpoints = own(window_endpoints).filter(keep).select(*KEYS, "scenario", "kind", "value").unionByName(new)
    mixed = [s for s, spec in SCENARIOS.items() if "services" in spec]
    forced = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(k).alias("service"), F.lit(v).alias("share"))
                       for s in mixed for k, v in SCENARIOS[s]["services"].items()])
    mix = own(shares).filter(~scenario.isin(mixed)).select(*KEYS, "scenario", "service", "share").unionByName(
        typical.select(*KEYS, F.explode(forced).alias("p")).select(*KEYS, "p.scenario", "p.service", "p.share"))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("device", F.concat_ws("|", F.col("device").cast("string"), "scenario")).drop("scenario")

    return keyed(windows), keyed(mix), keyed(endpoints)


def for_scenarios(profile: Profile) -> Profile:
    """The profile repeated under every ``device|scenario`` key."""
    def spread(table: DataFrame) -> DataFrame:
        names = F.explode(F.array(*[F.lit(s) for s in SCENARIOS]))
        return (table.withColumn("_s", names)
                .withColumn("device", F.concat_ws("|", F.col("device").cast("string"), "_s")).drop("_s"))

    return replace(profile, stats=spread(profile.stats), services=spread(profile.services),
                   endpoints=spread(profile.endpoints),
                   calibration=None if profile.calibration is None else spread(profile.calibration))


def injection_verdicts(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    scenario = F.substring_index("device", "|", -1)
    expected = F.create_map(*[x for s, spec in SCENARIOS.items()
                              for x in (F.lit(s), F.array(*[F.lit(c) for c in spec["expected"]]))])
    drivers = F.filter(F.array(*[F.when(F.col(c) > 0, c) for c in COMPONENTS]), lambda c: c.isNotNull())
    hit = F.size(F.array_intersect(drivers, F.element_at(expected, scenario))) > 0
    return scored.select(
        F.substring_index("device", "|", 1).alias("device"), scenario.alias("scenario"), "deviation_score",
        "top_component", (F.col("deviation_score") > threshold).alias("detected"), hit.alias("expected_driver"))
