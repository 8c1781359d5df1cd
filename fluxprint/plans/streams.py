"""Streaming operators and their batch forms over the event table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxprint.functions.scalars import bucket_start
from fluxprint.operators import device_features as D
from fluxprint.operators import evidence, graph
from fluxprint.plans import adapters as A
from fluxprint.plans import devices as V
from fluxprint.plans.registry import query, r
from fluxprint.session import configure, materialize, shared_dir
from fluxprint.streaming import features, ledger, telemetry
from fluxprint.streaming.sinks import BatchTables, append, drain, timed

W = A.WINDOW
LATE = 3600
CUTS = [A.START, A.START + 9 * A.DAY, A.START + 17 * A.DAY, A.END + W]


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = A.table(spark, sf, "events").schema
    return configure(spark).readStream.schema(schema).parquet(f"{sf}/events*.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def deliveries(spark: SparkSession, sf: str, name: str, cuts: list[int]) -> Iterator[DataFrame]:
    """The event table as it would arrive: a stream over a folder, again after each delivery of the time up to a cut.

    With the last one comes a heartbeat, a day after the table's end, which closes all its windows. It is
    of a device known by its MAC alone, as the leases have ended by then.
    """
    folder = new_folder(spark, name)
    events = A.table(spark, sf, "events")
    someone = A.devices(spark, sf).filter("id % 7 = 3").agg(F.min("id")).first()[0]
    t = A.epoch(F.col("ts"))
    for lo, hi in zip(cuts, cuts[1:]):
        part = events.filter((t >= lo) & (t < hi))
        if hi == cuts[-1]:
            beat = {"event_id": F.lit(0), "user_id": F.lit(someone), "event_type": F.lit("click"), "ts": F.timestamp_seconds(F.lit(A.END + A.DAY)), "value": F.lit(0), "props": F.lit('{"k": 0}')}
            part = part.unionByName(spark.range(1).select(*[beat[f.name].cast(f.dataType).alias(f.name) if f.name in beat else F.lit(None).cast(f.dataType).alias(f.name)
                                                            for f in events.schema.fields]))
        part.coalesce(1).write.mode("append").parquet(folder)
        yield spark.readStream.schema(events.schema).parquet(folder)


def packets(c: DataFrame) -> DataFrame:
    """Events as packets of connections that live up to five days."""
    kind, k = F.col("event_type"), F.col("k")
    start = F.floor(F.col("ts") / (5 * A.DAY)) * (5 * A.DAY)
    return c.select(
        "ts", F.concat_ws(":", F.col("device").cast("string"), (k % 5).cast("string"), start.cast("string")).alias("uid"),
        "orig_h", F.concat(F.lit("203.0.113."), (k % 5).cast("string")).alias("resp_h"), F.lit(40000).alias("orig_p"),
        F.lit(443).alias("resp_p"), F.lit("tcp").alias("proto"), start.cast("double").alias("flow_start"), (k % 2 == 0).alias("from_orig"),
        F.col("orig_bytes").alias("ip_bytes"), (kind == "view").alias("established"), (kind == "error").alias("rejected"), (kind == "click").alias("syn"))


K1 = f"""
pk AS (
  SELECT t, ws, device || ':' || (k % 5) || ':' || ((floor(t / {5 * A.DAY}) * {5 * A.DAY})::BIGINT) AS uid, orig_h, '203.0.113.' || (k % 5) AS resp_h,
    floor(t / {5 * A.DAY}) * {5 * A.DAY} AS fs, k % 2 = 0 AS fo, cents, event_type FROM conn),
kw AS (
  SELECT ws, uid, orig_h, resp_h, fs, coalesce(sum(cents) FILTER (WHERE fo), 0)::BIGINT AS ob, coalesce(sum(cents) FILTER (WHERE NOT fo), 0)::BIGINT AS rb,
    count(*) FILTER (WHERE fo) AS op, count(*) FILTER (WHERE NOT fo) AS rp, max(t) - any_value(fs) AS dur FROM pk GROUP BY ws, uid, orig_h, resp_h, fs),
kf AS (
  SELECT kw.*, coalesce((SELECT min(t) FROM pk WHERE pk.uid = kw.uid AND event_type = 'view') < ws + {W}, false) AS est,
    coalesce((SELECT min(t) FROM pk WHERE pk.uid = kw.uid AND event_type = 'error') < ws + {W}, false) AS rej,
    coalesce((SELECT min(t) FROM pk WHERE pk.uid = kw.uid AND event_type = 'click') < ws + {W}, false) AS syn FROM kw),
k1 AS (
  SELECT ws AS window_start, uid, orig_h, resp_h, 40000::INTEGER AS orig_p, 443::INTEGER AS resp_p, 'tcp' AS proto, {r('fs')} AS flow_start,
    ob AS orig_ip_bytes, rb AS resp_ip_bytes, op AS orig_pkts, rp AS resp_pkts, {r('dur')} AS observed_duration, est AS established,
    syn AND NOT est AND (rej OR ws + {W} - fs >= 3) AS failed, syn AS tcp_syn_observed, fs >= ws AS new_flow FROM kf)"""
K1_BASE = A.EVENTS_SQL.replace("cents AS ob, (cents", "cents, cents AS ob, (cents")


@query("k1_interval_telemetry", f"WITH {K1_BASE}, {K1} SELECT * FROM k1")
def _(spark, sf):
    return telemetry.interval_telemetry(packets(A.connections(spark, sf)), W)


@query("k1_interval_telemetry_stream", f"WITH {K1_BASE}, {K1} SELECT * FROM k1 WHERE window_start + {W} <= (SELECT max(t) FROM conn) - {LATE}")
def _(spark, sf):
    rows = packets(A.connections(spark, sf, event_stream(spark, sf)))
    return append(telemetry.interval_stream(rows, W, f"{LATE} seconds"), new_folder(spark, "intervals"))


def with_stragglers(c: DataFrame, spark: SparkSession, sf: str) -> list[DataFrame]:
    """Two deliveries of packets: the second one has those of every eleventh event of the first part again to come."""
    first = (F.col("ts") < CUTS[1]) & (F.col("k") % 11 != 0)
    return [c.filter(first), c.filter(~first)]


@query("k1_late_packets", f"""WITH {K1_BASE} SELECT ws AS window_start, count(*) AS late FROM conn WHERE t < {CUTS[1]} AND k % 11 = 0
  AND ws + {W} <= (SELECT max(t) FROM conn WHERE t < {CUTS[1]} AND k % 11 <> 0) - {LATE} GROUP BY ALL""")
def _(spark, sf):
    folder = new_folder(spark, "packets")
    rows = packets(A.connections(spark, sf)).withColumn("k", F.lit(0))
    for part in with_stragglers(A.connections(spark, sf), spark, sf):
        packets(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.drop("k").schema).parquet(f"{folder}/in")
        late = append(telemetry.late_packets(stream, W, LATE), f"{folder}/late")
    return late.groupBy("window_start").agg(F.sum("late").alias("late"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return A.connections(spark, sf).select(
        (F.col("device") % 10).alias("sensor_id"), "ts", F.col("event_id").alias("dropped_total"), (F.col("k") != 7).alias("clock_synchronized"),
        F.lit(float(A.START + A.DAY)).alias("started_at"))


@query("k2_sensor_health", f"""WITH {A.EVENTS_SQL}, h AS (SELECT device % 10 AS sensor_id, ws AS window_start, max(t) AS wm, max(event_id) AS dt,
    bool_and(k <> 7) AS cs FROM conn GROUP BY ALL)
  SELECT sensor_id, window_start, window_start + {W} AS window_end, {r('wm')} AS watermark, cs AS clock_synchronized,
    window_start >= {A.START + A.DAY} AND lead(window_start) OVER p IS NOT NULL AS complete, dt - coalesce(lag(dt) OVER p, 0) AS capture_drops
  FROM h WINDOW p AS (PARTITION BY sensor_id ORDER BY window_start)""")
def _(spark, sf):
    return telemetry.sensor_health(samples(spark, sf), W)


NOW = A.START + 25 * A.DAY + 100.5


@query("k3_eligible_windows", f"""WITH {A.EVENTS_SQL},
  runs AS (SELECT device, min(t) AS a, CASE WHEN device % 3 = 0 THEN max(t) END AS z, device % 3 = 1 AS active FROM conn GROUP BY device),
  h AS (SELECT device, ws, max(t) + 9000 AS wm, bool_and(event_type <> 'error') AS c FROM conn GROUP BY ALL),
  e AS (SELECT runs.*, CASE WHEN z IS NOT NULL THEN least({NOW}::DOUBLE, z) WHEN active THEN {NOW}::DOUBLE
      ELSE least({NOW}::DOUBLE, (SELECT max(wm) FROM h WHERE h.device = runs.device)) END AS en FROM runs)
  SELECT e.device AS run_id, g.ws::BIGINT AS window_start, coalesce(c, false) AND coalesce(wm >= g.ws + {W}, false) AS complete,
    {r(f'coalesce(wm, g.ws + {W})')} AS watermark
  FROM e JOIN range({A.START}, {A.END}, {W}) g(ws) ON g.ws >= floor(a / {W}) * {W} AND g.ws <= floor((en - 5) / {W}) * {W} - {W}
  LEFT JOIN h ON h.device = e.device AND h.ws = g.ws WHERE coalesce(wm >= g.ws + {W}, false) OR {NOW} >= g.ws + {W} + 30""")
def _(spark, sf):
    c = A.connections(spark, sf).withColumn("run_id", F.col("device"))
    runs = c.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("_z")).select(
        "run_id", "started_at", F.when(F.col("run_id") % 3 == 0, F.col("_z")).alias("stopped_at"), (F.col("run_id") % 3 == 1).alias("active"))
    health = c.groupBy("run_id", bucket_start(F.col("ts"), W).alias("window_start")).agg(
        (F.max("ts") + 9000).alias("watermark"), F.every(F.col("event_type") != "error").alias("complete"))
    return telemetry.eligible_windows(runs, health, W, NOW)


DEADLINE = 7_200


@query("k3_eligible_windows_stream", f"""WITH {A.EVENTS_SQL},
  runs AS (SELECT device, min(t) AS a, CASE WHEN device % 3 = 0 THEN max(t) END AS z, device % 3 <> 2 AS active FROM conn GROUP BY device),
  h AS (SELECT device, ws, max(t) + 9000 AS wm, bool_and(event_type <> 'error') AS c FROM conn GROUP BY ALL),
  m AS (SELECT max(wm) - {LATE} AS mark FROM h),
  e AS (SELECT runs.*, mark, CASE WHEN z IS NOT NULL THEN least(mark, z) WHEN active THEN mark
      ELSE least(mark, (SELECT max(wm) FROM h WHERE h.device = runs.device AND wm <= mark)) END AS en FROM runs, m),
  d AS (SELECT e.device, g.ws::BIGINT AS ws, mark, CASE WHEN wm <= g.ws + {W} + {DEADLINE} AND wm <= mark THEN wm END AS wm, c
    FROM e JOIN range({A.START}, {A.END + A.DAY}, {W}) g(ws) ON g.ws >= floor(a / {W}) * {W} AND g.ws <= floor((en - 5) / {W}) * {W} - {W}
    LEFT JOIN h ON h.device = e.device AND h.ws = g.ws)
  SELECT device AS run_id, ws AS window_start, coalesce(c AND wm >= ws + {W}, false) AS complete, {r(f'coalesce(wm, ws + {W})')} AS watermark, 'closed' AS fate
  FROM d WHERE coalesce(wm >= ws + {W}, false) OR mark >= ws + {W + DEADLINE}
  UNION ALL SELECT device, ws, c, {r('wm')}, 'late' FROM h, m WHERE wm > ws + {W + DEADLINE} AND wm <= mark""")
def _(spark, sf):
    batch = A.connections(spark, sf).withColumn("run_id", F.col("device"))
    none = {"active": "boolean", "window_start": "bigint", "watermark": "double", "complete": "boolean"}

    def rows(df, **values):
        return df.select("run_id", values["kind"].alias("kind"), values["at"].alias("at"), *[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()])

    spans = batch.groupBy("run_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    health = batch.groupBy("run_id", bucket_start(F.col("ts"), W).alias("window_start")).agg(
        (F.max("ts") + 9000).alias("watermark"), F.every(F.col("event_type") != "error").alias("complete"))
    signals = rows(spans, kind=F.lit("start"), at=F.col("a"), active=F.col("run_id") % 3 != 2).unionByName(
        rows(spans.filter("run_id % 3 = 0"), kind=F.lit("stop"), at=F.col("z"))).unionByName(
        rows(health, kind=F.lit("health"), at=F.col("watermark"), window_start=F.col("window_start"), watermark=F.col("watermark"), complete=F.col("complete")))
    folder = new_folder(spark, "signals")
    for lo, hi in zip(CUTS, [*CUTS[1:-1], A.END + A.DAY]):
        signals.filter((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(signals.schema).parquet(f"{folder}/in")
        closed = append(telemetry.window_stream(stream, W, LATE, DEADLINE), folder)
    return closed


ARRIVALS = f"""
ar AS (SELECT 's' || device % 20 AS stream, CASE WHEN k % 4 = 0 THEN ws - {2 * W} ELSE ws END AS window_start, 'h' || k % 2 AS payload_hash, t AS "at" FROM conn),
ing AS (
  SELECT *, CASE WHEN ok THEN 'accepted' WHEN known IS NULL THEN 'out_of_order' WHEN known = payload_hash THEN 'replay' ELSE 'conflict' END AS status
  FROM (SELECT *, max(CASE WHEN ok THEN payload_hash END) OVER (PARTITION BY stream, window_start) AS known FROM (
    SELECT *, coalesce(window_start > max(window_start) OVER (PARTITION BY stream ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM ar)))"""


def arrivals(c: DataFrame) -> DataFrame:
    ws = bucket_start(F.col("ts"), W)
    return c.select(F.concat(F.lit("s"), (F.col("device") % 20).cast("string")).alias("stream"),
                    F.when(F.col("k") % 4 == 0, ws - 2 * W).otherwise(ws).alias("window_start"),
                    F.concat(F.lit("h"), (F.col("k") % 2).cast("string")).alias("payload_hash"), F.col("ts").alias("at"))


INGEST = f"""WITH {A.EVENTS_SQL}, {ARRIVALS} SELECT stream, window_start, payload_hash, {r('"at"')} AS "at", status FROM ing"""


@query("k4_ingest", INGEST)
def _(spark, sf):
    return ledger.classify_ingest(arrivals(A.connections(spark, sf)))


@query("k4_ingest_stream", INGEST)
def _(spark, sf):
    return append(ledger.ingest_stream(arrivals(A.connections(spark, sf, event_stream(spark, sf)))), new_folder(spark, "ingest"))


@query("k4_conflicts", f"WITH {A.EVENTS_SQL}, {ARRIVALS} SELECT stream, window_start, count(*) AS arrivals FROM ar GROUP BY ALL HAVING count(DISTINCT payload_hash) > 1")
def _(spark, sf):
    return ledger.conflicts(arrivals(A.connections(spark, sf)), ["stream", "window_start"])


TIMEOUT = 43_200.0
BRANCH = f"""
br AS (SELECT device || ':' || (floor(t / {2 * A.DAY})::BIGINT) AS observation, CASE event_type WHEN 'click' THEN 'window' WHEN 'view' THEN 'gnn'
    WHEN 'error' THEN 'gnn' ELSE 'mud' END AS branch, 'h' || k % 2 AS payload_hash, t AS "at" FROM conn),
op AS (SELECT observation, min("at") AS o FROM br WHERE branch = 'window' GROUP BY ALL),
fi AS (SELECT observation, o, min("at") FILTER (WHERE branch = 'gnn') AS g, min("at") FILTER (WHERE branch = 'mud') AS m,
    min_by(payload_hash, "at") FILTER (WHERE branch = 'gnn') AS gh, min_by(payload_hash, "at") FILTER (WHERE branch = 'mud') AS mh
  FROM op LEFT JOIN (SELECT * FROM br JOIN op USING (observation) WHERE "at" >= op.o AND "at" < op.o + {TIMEOUT}::DOUBLE AND branch <> 'window') x USING (observation, o)
  GROUP BY ALL),
cl AS (SELECT *, g IS NULL OR m IS NULL AS partial, CASE WHEN g IS NOT NULL AND m IS NOT NULL THEN greatest(g, m) ELSE o + {TIMEOUT}::DOUBLE END AS closed FROM fi),
fa AS (
  SELECT br.*, CASE WHEN o IS NULL OR "at" < o THEN 'early' WHEN "at" = CASE branch WHEN 'gnn' THEN g ELSE m END THEN 'accepted'
    WHEN "at" > closed OR (partial AND "at" >= closed) THEN 'late' WHEN payload_hash = CASE branch WHEN 'gnn' THEN gh ELSE mh END THEN 'duplicate' ELSE 'conflict' END AS fate
  FROM br LEFT JOIN cl USING (observation) WHERE branch <> 'window')"""


def branches(c: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return c.select(
        F.concat_ws(":", F.col("device").cast("string"), F.floor(F.col("ts") / (2 * A.DAY)).cast("string")).alias("observation"),
        F.when(kind == "click", "window").when(kind.isin("view", "error"), "gnn").otherwise("mud").alias("branch"),
        F.concat(F.lit("h"), (F.col("k") % 2).cast("string")).alias("payload_hash"), F.col("ts").alias("at"))


@query("k5_deadline_join", f"""WITH {A.EVENTS_SQL}, {BRANCH} SELECT observation, {r('o')} AS opened_at, {r(f'o + {TIMEOUT}::DOUBLE')} AS deadline,
  {r('closed')} AS closed_at, partial, {r('g')} AS gnn_at, {r('m')} AS mud_at, gh AS gnn_hash, mh AS mud_hash FROM cl""")
def _(spark, sf):
    return ledger.deadline_join(branches(A.connections(spark, sf)), TIMEOUT)[0]


@query("k5_branch_fates", f"""WITH {A.EVENTS_SQL}, {BRANCH} SELECT observation, branch, payload_hash, {r('"at"')} AS "at", fate FROM fa""")
def _(spark, sf):
    return ledger.deadline_join(branches(A.connections(spark, sf)), TIMEOUT)[1]


@query("k5_deadline_join_stream", f"""WITH {A.EVENTS_SQL}, {BRANCH} SELECT observation, branch, payload_hash, {r('"at"')} AS "at", fate FROM fa
  UNION ALL SELECT observation, 'window', NULL, {r('closed')}, CASE WHEN partial THEN 'closed_partial' ELSE 'closed_complete' END FROM cl
    WHERE closed <= (SELECT max("at") FROM br) - {LATE}""")
def _(spark, sf):
    return append(ledger.deadline_stream(branches(A.connections(spark, sf, event_stream(spark, sf))), TIMEOUT, LATE), new_folder(spark, "deadline"))


@query("k6_incremental_features", V.sql(f"""SELECT c.device, c.ws AS window_start, c.tx_ip_bytes, coalesce(ud, 0) AS unique_destinations,
  {r('nf', 4)} AS new_destination_fraction, {r('m15', 4)} AS rolling_tx_mean_15m, {r('fg', 4)} AS flow_gap_min
  FROM (SELECT *, avg(tx_ip_bytes) OVER (PARTITION BY device, epoch ORDER BY ws ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS m15 FROM cells) c
  LEFT JOIN (SELECT device, ws, count(DISTINCT pa) AS ud FROM v WHERE o GROUP BY ALL) USING (device, ws)
  LEFT JOIN (SELECT device, ws, avg(nw) AS nf FROM (SELECT v.device, v.ws, CASE WHEN min(CASE WHEN available THEN v.ws END) OVER (PARTITION BY v.device, life, pa
      ORDER BY v.ws RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1.0::DOUBLE ELSE 0 END AS nw
    FROM v JOIN grid g ON g.device = v.device AND g.ws = v.ws WHERE o) GROUP BY ALL) USING (device, ws)
  LEFT JOIN (SELECT device, ws, min(g) AS fg FROM (SELECT device, ws, CASE WHEN p >= ws - {15 * W} AND t > p THEN t - p END AS g FROM (
      SELECT device, ws, t, lag(t) OVER (PARTITION BY device, epoch ORDER BY t) AS p FROM st)) GROUP BY ALL) USING (device, ws)"""), digits=4)
def _(spark, sf):
    return feature_stream(spark, sf).filter("available").select(
        "device", "window_start", "tx_ip_bytes", "unique_destinations", "new_destination_fraction", "rolling_tx_mean_15m", "flow_gap_min")


@query("k6_feature_stream", V.whole_table_sql(V.ALL_FEATURES), V.DIGITS)
def _(spark, sf):
    """All features of the stream; the degrees are those of the edges that a stream of its own has closed."""
    degrees = graph.local_degrees(edge_stream(spark, sf))
    table = feature_stream(spark, sf).join(degrees, ["device", "window_start"], "left")
    idle = [F.when(F.col("available"), F.coalesce(c, F.lit(0))).alias(c) if c in V.DEGREES else F.col(c) for c in V.ALL_FEATURES]
    return table.select("device", "window_start", "available", *idle)


def feature_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The feature stream over three deliveries; after each it ends and the next one takes it up from its checkpoint."""
    m = V.minutes(spark, sf, materialize)
    _rows, counts, base = V.profile_tables(m)
    counts, base = materialize(counts, "counts"), materialize(base, "baseline")
    known = materialize(A.devices(spark, sf), "inventory")
    owners = V.stored_owners(spark, sf, known)
    inventory = materialize(features.inventory_rows(known, A.START, A.outages(spark, sf, known), A.identity_spans(spark, sf, known)), "inventory")
    sink = features.DeviceFeatures(BatchTables(new_folder(spark, "features")), V.CLOCK, counts, base)
    for stream in deliveries(spark, sf, "deliveries", CUTS):
        rows = timed(V.resolved(spark, sf, A.telemetry(spark, sf, raw=stream), known, owners), F.greatest(F.col("flow_start"), F.col("window_start").cast("double")), LATE)
        drain(features.closed_windows(D.endpoint_view(rows, "event_time"), inventory, V.CLOCK), sink.process, f"{sink.tables.root}/checkpoint")
    return sink.tables.all(spark, "features").filter(F.col("window_start") < A.END)


@query("k6_incremental_edges", V.sql("SELECT * EXCLUDE (ws), ws AS window_start FROM ed"))
def _(spark, sf):
    return edge_stream(spark, sf)


def edge_stream(spark: SparkSession, sf: str) -> DataFrame:
    known = materialize(A.devices(spark, sf), "inventory")
    owners, grid, folder = V.stored_owners(spark, sf, known), materialize(V.grid(spark, sf, known), "grid"), new_folder(spark, "edges")
    for stream in deliveries(spark, sf, "deliveries", CUTS):
        edges = append(features.closed_edges(V.resolved(spark, sf, A.telemetry(spark, sf, raw=stream), known, owners), grid, V.CLOCK, LATE), folder)
    return edges


@query("k7_peer_limit", V.sql("""SELECT device, count(DISTINCT pa) AS peers FROM v WHERE o GROUP BY ALL HAVING count(DISTINCT pa) > 25"""))
def _(spark, sf):
    met = V.minutes(spark, sf).view.filter("originated").groupBy("device", "peer_address").agg(F.min("window_start").alias("first_seen"))
    return features.peer_limit_violations(met, 25)


@query("k8_freshness", f"""WITH {A.EVENTS_SQL} SELECT uid, {r(f'greatest(0, {A.TRAIN_END} - (ws + {W}))::DOUBLE')} AS age_seconds,
  greatest(0, {A.TRAIN_END} - (ws + {W})) <= {A.DAY} AS fresh FROM conn""")
def _(spark, sf):
    age, fresh = evidence.freshness(F.lit(float(A.TRAIN_END)), bucket_start(F.col("ts"), W) + W, float(A.DAY))
    return A.connections(spark, sf).select("uid", age.alias("age_seconds"), fresh.alias("fresh"))


@query("k9_status_counters", f"""WITH {A.EVENTS_SQL}, {BRANCH} SELECT count(*) FILTER (WHERE closed > {A.TRAIN_END}) AS open_observations,
  count(*) FILTER (WHERE closed <= {A.TRAIN_END}) AS closed_observations,
  {r(f'greatest(0, {A.TRAIN_END}.0::DOUBLE - min(o) FILTER (WHERE closed > {A.TRAIN_END}))')} AS oldest_open_age_seconds,
  (SELECT count(*) FROM fa WHERE fate = 'late' AND "at" <= {A.TRAIN_END}) AS late_branches, (SELECT count(DISTINCT o_custkey) FROM orders) AS decisions,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_actions FROM cl WHERE o <= {A.TRAIN_END}""")
def _(spark, sf):
    closed, fates = ledger.deadline_join(branches(A.connections(spark, sf)), TIMEOUT)
    d = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("decision_id"), F.when(F.col("o_orderstatus") == "P", "reserved").alias("status"))
    return ledger.status_counters(closed, fates, d, float(A.TRAIN_END))


@query("k10_close_ready", f"""WITH {A.EVENTS_SQL}, {BRANCH} SELECT observation, {r(f'o + {TIMEOUT}::DOUBLE')} AS deadline FROM cl
  WHERE o <= {A.TRAIN_END} AND ((g IS NOT NULL AND m IS NOT NULL) OR o + {TIMEOUT}::DOUBLE <= {A.TRAIN_END})""")
def _(spark, sf):
    closed, fates = ledger.deadline_join(branches(A.connections(spark, sf)), TIMEOUT)
    opened = closed.filter(F.col("opened_at") <= A.TRAIN_END).withColumn("status", F.lit("open"))
    held = fates.filter("fate = 'accepted'").select("observation", "branch")
    return ledger.close_ready(opened, held, float(A.TRAIN_END))
