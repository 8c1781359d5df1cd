"""Joining the two evidence branches, their freshness, and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxprint.functions.scalars import digest
from fluxprint.schemas import IDENTITY


# C9
def join_branches(windows: DataFrame, behaviour: DataFrame, policy: DataFrame) -> DataFrame:
    """Left join of both branches on the full identity.

    ``behaviour`` has ``fresh`` and ``policy`` has ``available``. A branch that
    belongs to no window is a mismatch, see :func:`identity_mismatches`.
    """
    b = behaviour.select(*IDENTITY, F.coalesce("fresh", F.lit(True)).alias("_fresh"), F.lit(True).alias("_b"))
    p = policy.select(*IDENTITY, F.coalesce("available", F.lit(False)).alias("_ok"), F.lit(True).alias("_p"))
    joined = windows.join(b, IDENTITY, "left").join(p, IDENTITY, "left")
    has_b, fresh, ok = F.col("_b").isNotNull(), F.coalesce("_fresh", F.lit(False)), F.coalesce("_ok", F.lit(False))
    out = joined.select(
        *windows.columns,
        F.when(has_b & fresh, "available").when(has_b, "stale").otherwise("unavailable").alias("behaviour_status"),
        F.when(ok, "available").otherwise("unavailable").alias("policy_status"),
        (~(has_b & fresh) | ~ok).alias("partial"))
    return out.withColumn("join_id", digest(*IDENTITY, "behaviour_status", "policy_status", "partial"))


def identity_mismatches(windows: DataFrame, branch: DataFrame, name: str) -> DataFrame:
    """Branch rows whose identity equals no window."""
    return branch.select(*IDENTITY).join(windows.select(*IDENTITY), IDENTITY, "left_anti").withColumn("branch", F.lit(name))


# K8, C20
def freshness(now: Column, window_end: Column, stale_after: float = 180.0) -> tuple[Column, Column]:
    age = F.greatest(F.lit(0.0), now - window_end)
    return age, age <= stale_after


# C20
def evidence_violations(inventory: DataFrame, evidence: DataFrame) -> DataFrame:
    """Devices missing, unknown or repeated in the evidence, and flags without scores.

    Both sides are keyed ``window_start, device``.
    """
    keys = ["window_start", "device"]
    counted = evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(F.col("behavioral_score").isNull() & F.col("behavioral_flag").isNotNull()).alias("_a"),
        F.bool_or(F.col("link_anomaly").isNull() & F.col("link_flag").isNotNull()).alias("_b"))
    both = inventory.select(*keys, F.lit(True).alias("_known")).distinct().join(counted, keys, "full")
    rules = F.array(
        F.when(F.col("_n").isNull(), "missing_device"), F.when(F.col("_known").isNull(), "unknown_device"),
        F.when(F.col("_n") > 1, "repeated_device"), F.when(F.col("_a"), "behavioral_flag_without_score"),
        F.when(F.col("_b"), "link_flag_without_score"))
    return both.select(*keys, F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


# A12
def trace_id(fields: list[str]) -> Column:
    """Identity digest when complete, else the first document id that is set."""
    complete = None
    for c in IDENTITY[:6]:
        term = F.col(c).isNotNull()
        complete = term if complete is None else complete & term
    ids = [F.col(c) for c in ("observation_id", "join_id", "decision_id") if c in fields]
    other = F.coalesce(*ids) if ids else F.lit(None)
    return F.when(complete, digest(*IDENTITY[:6])).otherwise(other)


# C16
def link_traces(events: DataFrame) -> DataFrame:
    """Give events without a trace the one of the decision they carry out.

    Decisions are one row per decision id, so the join keeps the event count. Only events that lack
    a trace and name a decision are joined: the others have no key, and would all meet in one task.
    """
    decisions = events.filter((F.col("kind") == "decision") & F.col("trace_id").isNotNull()).groupBy(
        F.col("decision_id").alias("_d")).agg(F.max_by("trace_id", "recorded_at").alias("_t"))
    asks = F.col("trace_id").isNull() & F.col("request_decision_id").isNotNull()
    linked = events.filter(asks).join(decisions, F.col("request_decision_id") == F.col("_d"), "left").withColumn("trace_id", F.col("_t")).drop("_d", "_t")
    return events.filter(~asks).unionByName(linked).withColumn("trace_id", F.coalesce("trace_id", F.lit("unlinked")))


# C17
def assemble_traces(events: DataFrame) -> DataFrame:
    """One row per trace: newest value per kind, counts, and stage latencies.

    Newest values are found by sorting, so events are dealt out first: a task then sorts its share of
    the traces and not all rows of a large split. Events without a trace are spread over many tasks.
    """
    lane = F.when(F.col("trace_id") == "unlinked", F.xxhash64(*events.columns))
    def of(kind: str, column: str) -> Column:
        # equal instants are decided by the value, so the result has no order
        newest = F.max(F.when(F.col("kind") == kind, F.struct("recorded_at", column)))
        return newest[column]

    def at(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("recorded_at")))

    kinds = ["window", "gnn_evidence", "mud_evidence", "joined_evidence", "decision", "controller_outcome"]
    rows = events.repartition("trace_id", lane).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("events"), *[at(k).alias(f"{k}_at") for k in kinds],
        of("window", "window_end").alias("window_end"), of("window", "first_flow").alias("first_flow"),
        of("window", "flows").alias("flows"), of("gnn_evidence", "flagged").alias("flagged"),
        of("mud_evidence", "denied").alias("denied"), of("decision", "proposals").alias("proposals"),
        of("controller_outcome", "installed_at").alias("installed_at"))
    return rows.filter((F.col("trace_id") != "unlinked") | F.col("window_at").isNotNull()).select(
        "*",
        (F.col("window_end") - F.col("first_flow")).alias("packet_to_window_close"),
        (F.col("joined_evidence_at") - F.col("window_end")).alias("window_close_to_join"),
        (F.col("decision_at") - F.col("joined_evidence_at")).alias("join_to_decision"),
        (F.col("installed_at") - F.col("decision_at")).alias("decision_to_install"),
        (F.col("installed_at") - F.col("first_flow")).alias("packet_to_install"))


def sensor_health(health: DataFrame) -> DataFrame:
    """State and named issues of each window's sensor; NULL never counts as healthy."""
    def is_true(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    clean = F.coalesce(F.col("capture_drops") == 0, F.lit(False))
    issues = F.array(
        F.when(~is_true("complete"), "incomplete_sensor_window"), F.when(~is_true("sensor_healthy"), "sensor_unhealthy"),
        F.when(~is_true("clock_synchronized"), "clock_unsynchronized"), F.when(~clean, "capture_drops_or_unavailable"),
        F.when(F.size("unavailable_device_ids") > 0, "device_identity_unavailable"))
    ok = is_true("complete") & is_true("sensor_healthy") & is_true("clock_synchronized") & clean
    return health.withColumn("sensor", F.when(ok, "healthy").otherwise("unhealthy")).withColumn(
        "issues", F.filter(issues, lambda x: x.isNotNull()))
