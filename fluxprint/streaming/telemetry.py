"""Packets to interval telemetry and sensor health, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.functions.scalars import bucket_start
from fluxprint.streaming.processors import LateProcessor, SignalProcessor, WindowProcessor
from fluxprint.streaming.sinks import timed

# Fixed value: seconds without an answer after which an attempt counts as failed.
HANDSHAKE_SECONDS = 3.0

CONNECTION = ["uid", "orig_h", "resp_h", "orig_p", "resp_p", "proto", "flow_start"]
SIGNALS = ["established_at", "rejected_at", "syn_at"]


def _sums() -> list[Column]:
    out = F.col("from_orig")
    t = F.col("ts")
    return [
        *[F.sum(F.when(c, F.col("ip_bytes")).otherwise(0)).alias(f"{side}_ip_bytes") for side, c in (("orig", out), ("resp", ~out))],
        F.count_if(out).alias("orig_pkts"), F.count_if(~out).alias("resp_pkts"), (F.max("ts") - F.first("flow_start")).alias("observed_duration"),
        F.min(F.when(F.col("established"), t)).alias("established_at"), F.min(F.when(F.col("rejected"), t)).alias("rejected_at"),
        F.min(F.when(F.col("syn"), t)).alias("syn_at")]


def _outcome(rows: DataFrame, window: int) -> DataFrame:
    """Flags of a row from the earliest signals of its connection up to its window's end."""
    end = F.col("window_start") + window
    established = F.coalesce(F.col("established_at") < end, F.lit(False))
    syn = F.coalesce(F.col("syn_at") < end, F.lit(False))
    refused = F.coalesce(F.col("rejected_at") < end, F.lit(False)) | (end - F.col("flow_start") >= HANDSHAKE_SECONDS)
    return rows.select(
        "window_start", *CONNECTION, "orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "resp_pkts", "observed_duration",
        established.alias("established"), ((F.col("proto") == "tcp") & syn & ~established & refused).alias("failed"),
        syn.alias("tcp_syn_observed"), (F.col("flow_start") >= F.col("window_start")).alias("new_flow"))


# K1
def interval_telemetry(packets: DataFrame, window: int) -> DataFrame:
    """One row per connection and window from a stored capture.

    ``packets``: ``ts``, the connection columns, ``from_orig``, ``ip_bytes`` and
    the signals ``established``, ``rejected``, ``syn``. Earliest signals are
    carried over the rows of one connection, which are as many as its windows.
    """
    rows = packets.groupBy(bucket_start(F.col("ts"), window).alias("window_start"), *CONNECTION).agg(*_sums())
    upto = Window.partitionBy("uid").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return _outcome(rows.withColumns({s: F.min(s).over(upto) for s in SIGNALS}), window)


def closed_sums(packets: DataFrame, window: int, lateness: str) -> DataFrame:
    """Sums of closed windows from a stream; a packet of a closed window is dropped."""
    timed = packets.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))
    sums = timed.withWatermark("event_time", lateness).groupBy(F.window("event_time", f"{window} seconds"), *CONNECTION).agg(*_sums())
    return sums.select(F.unix_seconds("window.start").alias("window_start"), *CONNECTION, "orig_ip_bytes", "resp_ip_bytes",
                       "orig_pkts", "resp_pkts", "observed_duration", *SIGNALS)


def interval_stream(packets: DataFrame, window: int, lateness: str) -> DataFrame:
    """Stream form of :func:`interval_telemetry`, over closed windows.

    Sums are the built-in aggregate. A connection's earliest signals are one row of keyed state
    for each, however long it is silent: a forgotten connection could turn from established to failed.
    """
    sums = closed_sums(packets, window, lateness)
    told = sums.groupBy("uid").transformWithState(SignalProcessor(sums.columns), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema.fields), "Append", "None")
    return _outcome(told, window)


def late_packets(packets: DataFrame, window: int, lateness: float, spread: int = 64) -> DataFrame:
    """How many packets came after their window was closed, as ``window_start, late`` counts that add up.

    A window's packets are spread over ``spread`` keys by their connection; nothing is kept in state.
    """
    rows = timed(packets, F.col("ts"), lateness).select(bucket_start(F.col("ts"), window).alias("window_start"), F.pmod(F.xxhash64("uid"), F.lit(spread)).alias("lane"), "event_time")
    return rows.groupBy("window_start", "lane").transformWithState(LateProcessor(window), LateProcessor.OUTPUT, "Append", "EventTime")


# K2
def sensor_health(samples: DataFrame, window: int, keys: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """Watermark, completeness and drops per window from counter samples.

    ``samples``: ``ts, dropped_total, clock_synchronized, started_at``.
    """
    rows = samples.groupBy(*keys, bucket_start(F.col("ts"), window).alias("window_start")).agg(
        F.max("ts").alias("watermark"), F.max("dropped_total").alias("dropped_total"),
        F.every("clock_synchronized").alias("clock_synchronized"), F.min("started_at").alias("_started"))
    order = Window.partitionBy(*keys).orderBy("window_start")
    return rows.select(
        *keys, "window_start", (F.col("window_start") + window).alias("window_end"), "watermark", "clock_synchronized",
        # only a window that began after the sensor did, and that a later one closed, is complete
        ((F.col("_started") <= F.col("window_start")) & F.lead("window_start").over(order).isNotNull()).alias("complete"),
        (F.col("dropped_total") - F.coalesce(F.lag("dropped_total").over(order), F.lit(0))).alias("capture_drops"))


# K3
def eligible_windows(runs: DataFrame, health: DataFrame, window: int, now: float, deadline: float = 30.0, close_delay: float = 5.0) -> DataFrame:
    """Windows of each run that may be closed now, silent ones included.

    A window is due when its sensor's watermark has passed its end, or when the
    deadline has; then a missing health row makes it an explicit incomplete one.
    ``runs``: ``run_id, started_at, stopped_at``; ``health`` is keyed by run.
    """
    last = health.groupBy("run_id").agg(F.max("watermark").alias("_mark"))
    end = F.when(F.col("stopped_at").isNotNull(), F.least(F.lit(now), F.col("stopped_at"))).when(
        F.col("active"), F.lit(now)).otherwise(F.least(F.lit(now), F.col("_mark")))
    step = F.lit(window).cast("bigint")
    lo = bucket_start(F.col("started_at"), window)
    hi = bucket_start(end - close_delay, window) - window
    grid = runs.join(last, "run_id", "left").withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi >= _lo").select(
        "run_id", F.explode(F.sequence("_lo", "_hi", step)).alias("window_start"))
    seen = health.select("run_id", "window_start", "watermark", "complete")
    due = grid.join(seen, ["run_id", "window_start"], "left")
    over = F.col("window_start") + window
    progressed = F.coalesce(F.col("watermark") >= over, F.lit(False))
    return due.filter(progressed | (F.lit(now) >= over + deadline)).select(
        "run_id", "window_start", (F.coalesce("complete", F.lit(False)) & progressed).alias("complete"),
        F.coalesce("watermark", over.cast("double")).alias("watermark"))


def window_stream(signals: DataFrame, window: int, lateness: float, deadline: float = 30.0, close_delay: float = 5.0) -> DataFrame:
    """Stream form of :func:`eligible_windows`: windows of each run as they close, silent ones by timers.

    ``signals``: ``run_id, kind, at`` with kind ``start`` (and ``active``), ``stop`` or ``health`` (and
    ``window_start, watermark, complete``). Event time is ``at``, for health the watermark.
    """
    return timed(signals, F.col("at"), lateness).groupBy("run_id").transformWithState(
        WindowProcessor(window, deadline, close_delay), WindowProcessor.OUTPUT, "Append", "EventTime")
