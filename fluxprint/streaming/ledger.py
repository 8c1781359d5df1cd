"""Idempotent ingest and the deadline join of two evidence branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.streaming.processors import DeadlineProcessor, IngestProcessor
from fluxprint.streaming.sinks import timed

BRANCHES = ["gnn", "mud"]


INGEST_SLICE = 3600.0


# K4
def classify_ingest(arrivals: DataFrame) -> DataFrame:
    """Accepted, replayed, conflicting or out-of-order windows of each stream.

    ``arrivals``: ``stream, window_start, payload_hash, at``. Time must move on:
    exactly the strict running maxima of ``window_start`` are accepted. The running
    maximum is taken within slices of arrival time and carried over them by one row
    per slice, so no task holds a whole stream; an accepted window is known for ever.
    """
    sliced = arrivals.withColumn("_slice", F.floor(F.col("at") / INGEST_SLICE))
    tops = sliced.groupBy("stream", "_slice").agg(F.max("window_start").alias("_m"))
    earlier = Window.partitionBy("stream").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("stream", "_slice", F.max("_m").over(earlier).alias("_carried"))
    within = Window.partitionBy("stream", "_slice").orderBy("at", "payload_hash").rowsBetween(Window.unboundedPreceding, -1)
    top = F.greatest("_carried", F.max("window_start").over(within))
    marked = sliced.join(carried, ["stream", "_slice"]).withColumn("_top", top) \
        .withColumn("_ok", F.col("_top").isNull() | (F.col("window_start") > F.col("_top")))
    known = marked.filter("_ok").groupBy("stream", "window_start").agg(F.max("payload_hash").alias("_known"))
    status = (F.when(F.col("_ok"), "accepted").when(F.col("_known").isNull(), "out_of_order")
              .when(F.col("_known") == F.col("payload_hash"), "replay").otherwise("conflict"))
    return marked.join(known, ["stream", "window_start"], "left").select(*arrivals.columns, status.alias("status"))


def ingest_stream(arrivals: DataFrame) -> DataFrame:
    """Stream form of :func:`classify_ingest`: fates as windows arrive, accepted windows in keyed state for ever."""
    return arrivals.groupBy("stream").transformWithState(IngestProcessor(), IngestProcessor.OUTPUT, "Append", "None")


def first_arrivals(arrivals: DataFrame, event_time: str, keys: list[str], within: str) -> DataFrame:
    """Plain replays removed by the built-in stateful operator, for streams without conflicts."""
    return arrivals.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def conflicts(arrivals: DataFrame, keys: list[str], value: str = "payload_hash") -> DataFrame:
    """Keys that arrived with different contents; min and max tell without a set."""
    return (arrivals.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count(F.lit(1)).alias("arrivals"))
            .filter("_a <> _b").select(*keys, "arrivals"))


# K5
def close_times(arrivals: DataFrame, timeout: float) -> DataFrame:
    """When each observation opened and closed, and which branches made it.

    ``arrivals``: ``observation, branch, payload_hash, at`` with the observation
    itself as branch ``window``. It closes with its second branch or at its
    deadline; a branch at the deadline is late.
    """
    opened = arrivals.groupBy("observation").agg(F.min(F.when(F.col("branch") == "window", F.col("at"))).alias("opened_at"))
    timed = arrivals.join(opened.filter("opened_at is not null"), "observation")
    inside = (F.col("at") >= F.col("opened_at")) & (F.col("at") < F.col("opened_at") + timeout)
    firsts = [F.min(F.when((F.col("branch") == b) & inside, F.struct("at", "payload_hash"))).alias(f"_{b}") for b in BRANCHES]
    agg = timed.groupBy("observation", "opened_at").agg(*firsts)
    both = F.col("_gnn").isNotNull() & F.col("_mud").isNotNull()
    return agg.select(
        "observation", "opened_at", (F.col("opened_at") + timeout).alias("deadline"),
        F.when(both, F.greatest("_gnn.at", "_mud.at")).otherwise(F.col("opened_at") + timeout).alias("closed_at"),
        (~both).alias("partial"), *[F.col(f"_{b}.at").alias(f"{b}_at") for b in BRANCHES],
        *[F.col(f"_{b}.payload_hash").alias(f"{b}_hash") for b in BRANCHES])


def deadline_join(arrivals: DataFrame, timeout: float) -> tuple[DataFrame, DataFrame]:
    """Closed observations, and every branch arrival with its fate.

    Fates: accepted, duplicate, conflict, late, and early for a branch without an
    open observation.
    """
    closed = close_times(arrivals, timeout)
    return closed, fates_of(arrivals, closed)


def fates_of(arrivals: DataFrame, closed: DataFrame) -> DataFrame:
    """The fate of each branch arrival, given when its observation closed and by what."""
    rows = arrivals.filter(F.col("branch").isin(BRANCHES)).join(closed, "observation", "left")
    first_at = F.when(F.col("branch") == "gnn", F.col("gnn_at")).otherwise(F.col("mud_at"))
    first_hash = F.when(F.col("branch") == "gnn", F.col("gnn_hash")).otherwise(F.col("mud_hash"))
    at, closing = F.col("at"), F.col("closed_at")
    is_first = (at == first_at) & (F.col("payload_hash") == first_hash)
    fate = (F.when(F.col("opened_at").isNull() | (at < F.col("opened_at")), "early")
            .when(F.coalesce(is_first, F.lit(False)), "accepted")
            .when(~((at < closing) | ((at == closing) & ~F.col("partial"))), "late")
            .when(F.col("payload_hash") == first_hash, "duplicate").otherwise("conflict"))
    return rows.select(*arrivals.columns, fate.alias("fate"))


def deadline_stream(arrivals: DataFrame, timeout: float, lateness: float = 0.0) -> DataFrame:
    """Stream form of :func:`deadline_join`: fates as branches arrive, and a row of branch ``window`` when an observation closes.

    An observation without a second branch is closed by a timer, once event time less ``lateness``
    has reached its deadline, whether or not anything more arrives for it.
    """
    return timed(arrivals, F.col("at"), lateness).groupBy("observation").transformWithState(
        DeadlineProcessor(timeout), DeadlineProcessor.OUTPUT, "Append", "EventTime")


def joined_streams(behaviour: DataFrame, policy: DataFrame, keys: list[str], event_time: str, lateness: str) -> DataFrame:
    """Plain case of two streams: the built-in outer join, which emits a lone branch after the watermark."""
    b = behaviour.withWatermark(event_time, lateness).alias("b")
    p = policy.withWatermark(event_time, lateness).alias("p")
    condition = F.col(f"b.{event_time}") == F.col(f"p.{event_time}")
    for k in keys:
        condition = condition & (F.col(f"b.{k}") == F.col(f"p.{k}"))
    return b.join(p, condition, "full_outer")


# K9
def status_counters(closed: DataFrame, fates: DataFrame, decisions: DataFrame, now: float) -> DataFrame:
    """Open and closed observations, late branches, decisions, pending actions, oldest age; one row."""
    is_open = F.col("closed_at") > now
    a = closed.filter(F.col("opened_at") <= now).agg(
        F.count_if(is_open).alias("open_observations"), F.count_if(~is_open).alias("closed_observations"),
        F.greatest(F.lit(0.0), F.lit(now) - F.min(F.when(is_open, F.col("opened_at")))).alias("oldest_open_age_seconds"))
    late = fates.filter((F.col("fate") == "late") & (F.col("at") <= now)).agg(F.count(F.lit(1)).alias("n"))
    d = decisions.agg(F.count_distinct("decision_id").alias("n"), F.count_if(F.col("status") == "reserved").alias("p")).select(F.struct("n", "p").alias("d"))
    counts = d.scalar()
    return a.withColumn("late_branches", late.scalar()).withColumn("_d", counts).select(
        "open_observations", "closed_observations", "late_branches", F.col("_d.n").alias("decisions"),
        F.col("_d.p").alias("pending_actions"), "oldest_open_age_seconds")


# K10
def close_ready(observations: DataFrame, branches: DataFrame, now: float) -> DataFrame:
    """Open observations, with their deadlines, that need not wait: all branches are there, or time is up."""
    complete = branches.filter(F.col("branch").isin(BRANCHES)).groupBy("observation") \
        .agg(F.count_distinct("branch").alias("_present")).filter(F.col("_present") == len(BRANCHES))
    waiting = observations.filter(F.col("status") == "open").join(complete, "observation", "left")
    return waiting.filter(F.col("_present").isNotNull() | (F.col("deadline") <= now)).select("observation", "deadline")
