"""From joined evidence to response proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.functions import ordered
from fluxprint.functions.scalars import digest

SCOPE = ["target_device_id", "scope_proto", "scope_ip", "scope_port", "tier"]


# C18
def proposals(exchanges: DataFrame, scores: DataFrame) -> DataFrame:
    """One proposal per denied exchange, and an alert for flagged devices without one.

    ``exchanges`` and ``scores`` are keyed by ``window_start`` and device.
    """
    flags = scores.select("window_start", F.col("device").alias("target_device_id"), "behavioral_flag", "link_flag")
    denied = exchanges.filter(F.col("permission") == "denied").select(
        "window_start", F.col("initiator_device_id").alias("target_device_id"), F.col("proto").alias("scope_proto"),
        F.col("responder_ip").alias("scope_ip"), F.col("service_port").alias("scope_port"), "flow_uid")
    keys = ["window_start", "target_device_id"]
    link = F.coalesce("link_flag", F.lit(False))
    from_flows = denied.join(flags, keys, "left").select(
        *denied.columns, F.when(link, "block").otherwise("alert").alias("tier"),
        F.when(link, "forbidden_exchange_with_link_anomaly").otherwise("forbidden_exchange").alias("reason"))
    alone = flags.filter("behavioral_flag").join(denied.select(*keys).distinct(), keys, "left_anti")
    from_flags = alone.select(*keys, F.lit("alert").alias("tier"),
                              F.lit("behavioral_anomaly_requires_flow_attribution").alias("reason"))
    return from_flows.unionByName(from_flags, allowMissingColumns=True)


# G5
def consecutive_windows(rows: DataFrame, window: int) -> DataFrame:
    """Run length of each scope's windows; repeats inside a window do not count.

    ``first_uid`` names the first proposal of the scope in the window. A flood of
    proposals is folded by the partial aggregate, so only windows are sorted.
    """
    seen = rows.groupBy(*SCOPE, "window_start").agg(F.min("flow_uid").alias("first_uid"))
    return ordered.islands(seen, SCOPE, "window_start", window).withColumnRenamed("consecutive", "consecutive_windows")


# G6
def apply_cooldown(rows: DataFrame, window: int, cooldown: float, escalate_after: int | None = None) -> DataFrame:
    """Cooldown against the last proposal of the scope, then escalation.

    The scope key is fixed before escalation changes the tier. Proposals are
    made at the window's end; a second one in the same window is a replay, which
    neither counts nor cools down.
    """
    runs = consecutive_windows(rows, window)
    last = F.lag("window_start").over(Window.partitionBy(*SCOPE).orderBy("window_start"))
    state = runs.withColumn("_since", F.col("window_start") - last)
    keys = [*SCOPE, "window_start"]
    s = state.select(*[F.col(k).alias("_s_" + k) for k in keys], "consecutive_windows", "_since", "first_uid")
    condition = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col("_s_" + k))
        condition = term if condition is None else condition & term
    joined = rows.join(s, condition).drop(*["_s_" + k for k in keys])
    # only the first proposal of a scope in a window sees the time since the last one
    first = F.col("flow_uid").eqNullSafe(F.col("first_uid"))
    cool = F.coalesce(first & (F.col("_since") < cooldown), F.lit(False))
    out = joined.withColumn("scope_key", digest(*SCOPE)).withColumn("cooldown_active", cool).drop("first_uid")
    if escalate_after is not None:
        hit = ((F.col("tier") == "alert") & (F.col("reason") == "forbidden_exchange")
               & (F.col("consecutive_windows") >= escalate_after))
        out = out.withColumns({"reason": F.when(hit, "repeated_forbidden_exchange").otherwise(F.col("reason")),
                               "tier": F.when(hit, "block").otherwise(F.col("tier"))})
    return out.drop("_since")


# C19
def apply_overrides(rows: DataFrame, overrides: DataFrame, at: Column, slice_seconds: float = 86_400.0) -> DataFrame:
    """First unexpired suppression in file order, for the device or for all.

    Walking from the latest expiry backwards, the smallest ordinal so far is the first override
    that is still live: a running minimum per target. Distinct instants of a device, and of all
    devices for what holds for all, are looked up in it by order; no list is ever built.
    """
    # time runs backwards: an override counts for the instants before its expiry
    live = overrides.filter(F.col("action") == "suppress").select(
        "target_device_id", (-F.col("expires_at")).alias("_at"), F.struct("ordinal", "override_id").alias("_first"))
    asked = rows.withColumn("_at", -at.cast("double"))
    own = ordered.running_lookup(asked.filter("target_device_id is not null").select("target_device_id", "_at").distinct(), live.filter("target_device_id is not null"),
                                 ["target_device_id"], "_at", "_first", slice_seconds, F.min, "_own", inclusive=False)
    scope = F.when(F.col("_at").isNotNull(), "all").alias("_scope")
    common = ordered.running_lookup(asked.select(scope, "_at").distinct(), live.filter("target_device_id is null").select(scope, "_at", "_first"),
                                    ["_scope"], "_at", "_first", slice_seconds, F.min, "_all", inclusive=False)
    joined = asked.join(own, ["target_device_id", "_at"], "left").join(common.drop("_scope"), "_at", "left")
    return joined.select(*rows.columns, F.least("_own", "_all")["override_id"].alias("override_id"))


def dispatchable(rows: DataFrame, bound: Column) -> DataFrame:
    return rows.withColumn("dispatch_eligible", bound & ~F.col("cooldown_active") & F.col("override_id").isNull())
