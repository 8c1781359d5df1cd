"""Display rollups over scores, exchanges, proposals, actions and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.functions import ordered, stats
from fluxprint.functions.scalars import display_name


# I7
def risk_class(status: Column, a: Column, b: Column) -> Column:
    scored = F.coalesce(status.isin("ok", "active"), F.lit(False))
    yes = F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    no = F.coalesce(~a & ~b, F.lit(False))
    return F.when(yes, "anomalous").when(scored & no, "normal").when(scored, "monitoring").otherwise("unscored")


def device_rollup(devices: DataFrame, scores: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Every device with its evidence in the newest window and its permission counts."""
    newest = scores.select(F.max("window_start").alias("w"))
    now = scores.filter(F.col("window_start") == newest.scalar())
    current = exchanges.filter(F.col("window_start") == newest.scalar())
    seen = current.select("observed_at", F.explode(F.filter(
        F.array("initiator_device_id", "responder_device_id"), lambda d: d.isNotNull())).alias("device")).groupBy("device").agg(
        F.max("observed_at").alias("last_seen"))
    counts = current.groupBy(F.col("initiator_device_id").alias("device")).agg(
        *[F.count_if(F.col("permission") == p).alias(p) for p in ("allowed", "denied", "unknown_policy", "unknown_device")])
    rows = (devices.select("device", "device_type").join(now.drop("device_type", "window_start"), "device", "left")
            .join(seen, "device", "left").join(counts, "device", "left"))
    return rows.select(
        "device", display_name(F.col("device")).alias("name"), "device_type",
        F.coalesce("status", F.lit("unavailable")).alias("status"),
        risk_class(F.col("status"), F.col("behavioral_flag"), F.col("link_flag")).alias("risk"),
        "behavioral_score", "link_anomaly", "last_seen",
        *[F.coalesce(p, F.lit(0)).alias(p) for p in ("allowed", "denied", "unknown_policy", "unknown_device")])


# C15, I8
def with_flow_bytes(exchanges: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Bytes of the flow behind each exchange; uid and window name one interval row."""
    flows = telemetry.select(F.col("uid").alias("flow_uid"), "window_start",
                             (F.col("orig_ip_bytes") + F.col("resp_ip_bytes")).alias("bytes"))
    return exchanges.join(flows, ["flow_uid", "window_start"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def relationship_rollup(exchanges: DataFrame, telemetry: DataFrame, windows: int = 5) -> DataFrame:
    """Relations seen in the newest windows, most denied first.

    The newest windows are at most ``windows`` rows, so choosing them is a small
    aggregate and the exchanges are filtered before any other work.
    """
    newest = exchanges.select("window_start").distinct().orderBy(F.desc("window_start")).limit(windows)
    rows = with_flow_bytes(exchanges.join(newest, "window_start", "left_semi"), telemetry)

    def node(device: str, ip: str) -> Column:
        return F.coalesce(device, F.concat(F.lit("external:"), F.col(ip)))

    permission = F.col("permission")
    return rows.groupBy(
        node("initiator_device_id", "initiator_ip").alias("source"),
        node("responder_device_id", "responder_ip").alias("target"), "proto", F.col("service_port").alias("port")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("bytes"),
        F.count_if(permission == "allowed").alias("allowed"), F.count_if(permission == "denied").alias("denied"),
        F.count_if(permission.startswith("unknown")).alias("unknown"), F.max("observed_at").alias("last_seen"),
    ).orderBy(F.desc("denied"), F.desc("count"), "source", "target", "proto", "port")


# I9
def security_alerts(proposals: DataFrame, key: str = "proposal_id") -> DataFrame:
    """Newest row of each proposal; a partial max, no sort of a whole key."""
    fields = ["window_start", *[c for c in proposals.columns if c not in (key, "window_start")]]
    newest = proposals.groupBy(key).agg(F.max(F.struct(*fields)).alias("_row"))
    return newest.select(key, "_row.*")


def operations_alerts(problems: DataFrame) -> DataFrame:
    """Problems with the same run and text folded to one alert with its extent."""
    return problems.groupBy("run_id", "text").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("window_start").alias("first_window"),
        F.max("window_start").alias("window_start"))


def limited_alerts(alerts: DataFrame, limit: int, tie: str) -> DataFrame:
    """All current alerts, then the newest others up to the limit."""
    current = alerts.filter("current")
    history = alerts.filter(~F.col("current")).orderBy(F.desc("window_start"), tie).limit(limit)
    room = F.greatest(F.lit(0), F.lit(limit) - alerts.select(F.count_if("current")).scalar())
    placed = history.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("window_start"), tie)))
    return current.unionByName(placed.filter(F.col("_n") <= room).drop("_n"))


# I10
def action_lifecycle(outcomes: DataFrame) -> DataFrame:
    """Latest state per decision and its states in order of record.

    A decision has one entry per change of its action, a short list.
    """
    states = F.array_sort(F.collect_list(F.struct("recorded_at", "status")))
    return outcomes.groupBy("decision_id").agg(
        F.max(F.struct("recorded_at", "status"))["status"].alias("status"), F.max("recorded_at").alias("updated_at"),
        F.count(F.lit(1)).alias("changes"), F.array_join(F.transform(states, lambda s: s["status"]), ">").alias("lifecycle"))


# I11
def overview(devices: DataFrame, windows: DataFrame, now: float, stale_after: float = 180.0) -> DataFrame:
    """One row of headline counts; each input is reduced before the two meet."""
    d = devices.agg(F.count(F.lit(1)).alias("devices"), F.count_if(F.col("status").isin("ok", "active")).alias("active_devices"),
                    F.count_if(F.col("risk") == "anomalous").alias("anomalous_devices"))
    latency = F.col("window_close_to_join")
    ranks = stats.order_statistics(windows, [], "window_close_to_join", {
        "_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2), "_p95": lambda n: stats.nearest_rank(n, 0.95)})
    w = windows.agg(F.count(F.lit(1)).alias("windows"),
                    F.count_if((F.col("sensor") == "healthy") & ~F.col("partial")).alias("healthy_windows"),
                    F.count(latency).alias("timed_windows"), F.max("window_end").alias("_last"))
    age = F.greatest(F.lit(0.0), F.lit(now) - F.col("_last"))
    # the other two are single rows, taken in as scalar subqueries
    one = d.withColumn("_w", w.select(F.struct("*").alias("s")).scalar()).withColumn("_r", ranks.select(F.struct("*").alias("s")).scalar())
    return one.select("devices", "active_devices", "anomalous_devices", "_w.*", "_r.*").select(
        "devices", "active_devices", "anomalous_devices", "windows", "healthy_windows", "timed_windows",
        ((F.col("_lo") + F.col("_hi")) / 2).alias("p50_window_to_join"), F.col("_p95").alias("p95_window_to_join"),
        age.alias("observation_age_seconds"), (age <= stale_after).alias("evidence_fresh"))


# I12
def permission_differences(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Flows whose recorded permission is missing, extra or different."""
    keys = ["flow_uid", "window_start"]
    both = recorded.select(*keys, F.col("permission").alias("recorded")).join(
        recomputed.select(*keys, F.col("permission").alias("recomputed")), keys, "full")
    return both.filter(~F.col("recorded").eqNullSafe(F.col("recomputed")))


def flag_totals(scores: DataFrame, by: Sequence[str] = ("device",)) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count("behavioral_score").alias("scored_windows"), F.count_if("behavioral_flag").alias("behavior_flags"),
        F.count_if("link_flag").alias("connection_flags"))


# I13
def latency_percentiles(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Floor-rank p50 and p95, and the maximum, of groups of any size."""
    return stats.order_statistics(rows, keys, value, {
        "p50": lambda n: stats.nearest_rank(n, 0.5, "floor"), "p95": lambda n: stats.nearest_rank(n, 0.95, "floor"),
        "max": lambda n: n - 1})


# G10
def run_check(windows: DataFrame, keys: Sequence[str], window: int, k: int, now: Column, stale_after: float) -> DataFrame:
    """Are the ``k`` newest windows of a run consecutive and complete, and the newest fresh?"""
    newest = ordered.top_per_group(windows, keys, [F.desc("window_start")], k)
    gap = F.lag("window_start").over(Window.partitionBy(*keys).orderBy("window_start"))
    rows = newest.withColumn("_step", F.col("window_start") - gap)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"), F.every(F.coalesce(F.col("_step") == window, F.lit(True))).alias("consecutive"),
        F.every("complete").alias("all_complete"), (now - F.max("window_end") < stale_after).alias("fresh"),
        (F.count(F.lit(1)) >= k).alias("enough"))


# G9
def drop_deltas(health: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops per window from a running counter; a sensor is bounded by its windows."""
    w = Window.partitionBy(*keys).orderBy("window_start")
    return health.withColumn("capture_drops", F.col("dropped_total") - F.coalesce(F.lag("dropped_total").over(w), F.lit(0)))
