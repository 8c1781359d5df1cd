"""File-format operators over text that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxprint.operators import profile
from fluxprint.plans import adapters as A
from fluxprint.plans import behaviour
from fluxprint.plans.registry import ORACLES, query, r
from fluxprint.session import shared_dir
from fluxprint.sources import files, text_logs

FIELDS = ["ts", "uid", "id.orig_h", "id.resp_h", "id.resp_p", "proto", "service", "conn_state", "orig_bytes", "resp_bytes", "orig_l2_addr"]


CHUNK = 1 << 12  # event ids below one header


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The events as TSV log files, read back: folders per kind, and headers that turn the column order within a file."""
    c = A.connections(spark, sf)
    cells = {"ts": F.col("ts").cast("string"), "uid": F.col("uid"), "id.orig_h": F.col("orig_h"), "id.resp_h": F.col("resp_h"),
             "id.resp_p": F.when(F.col("k") % 9 == 0, "-").otherwise(F.col("resp_p").cast("string")), "proto": F.col("proto"),
             "service": F.coalesce("service", F.lit("-")), "conn_state": F.col("conn_state"),
             "orig_bytes": F.when(F.col("k") % 8 == 0, "n/a").otherwise(F.col("orig_bytes").cast("string")),
             "resp_bytes": F.col("resp_bytes").cast("string"), "orig_l2_addr": F.col("orig_mac")}
    forward = F.concat_ws("\t", *[cells[f] for f in FIELDS])
    backward = F.concat_ws("\t", *[cells[f] for f in reversed(FIELDS)])
    chunk = F.expr(f"event_id div {CHUNK}")
    turned = chunk % 2 == 1
    rows = c.select(F.col("event_type").alias("kind"), chunk.alias("chunk"), (F.col("event_id") + 10).alias("place"),
                    F.when(turned, backward).otherwise(forward).alias("value"))
    head = F.when(F.col("chunk") % 2 == 1, "\t".join(["#fields", *reversed(FIELDS)])).otherwise("\t".join(["#fields", *FIELDS]))
    marks = F.array(F.struct(F.lit(1).cast("bigint").alias("place"), F.lit("#separator x09").alias("value")),
                    F.struct(F.lit(2).cast("bigint").alias("place"), head.alias("value")))
    heads = rows.select("kind", "chunk").distinct().select("kind", "chunk", F.explode(marks).alias("h")).select("kind", "chunk", "h.*")
    path = folder(spark, "logs")
    rows.unionByName(heads).repartition("kind", "chunk").sortWithinPartitions("kind", "chunk", "place").select("kind", "value") \
        .write.partitionBy("kind").text(path)
    return text_logs.read_lines(spark, path)


@query("a1_header_tsv", f"""WITH {A.EVENTS_SQL} SELECT event_type AS file, uid, resp_h, CASE WHEN k % 9 = 0 THEN '-' ELSE resp_p::VARCHAR END AS port,
  coalesce(service, '-') AS service FROM conn""")
def _(spark, sf):
    rec = F.col("record")
    return text_logs.header_records(log_lines(spark, sf)).select(
        F.regexp_extract("file", "kind=([^/]*)", 1).alias("file"), rec["uid"].alias("uid"), rec["id.resp_h"].alias("resp_h"), rec["id.resp_p"].alias("port"), rec["service"].alias("service"))


@query("a2_typed_connections", f"""WITH {A.EVENTS_SQL} SELECT uid, {r('t')} AS ts, orig_h, CASE WHEN k % 9 <> 0 THEN resp_p END AS resp_p, service,
  CASE WHEN k % 8 <> 0 THEN ob END AS orig_bytes, rb AS resp_bytes FROM conn""")
def _(spark, sf):
    c = text_logs.connections(text_logs.header_records(log_lines(spark, sf)))
    return c.select("uid", "ts", F.col("`id.orig_h`").alias("orig_h"), F.col("`id.resp_p`").alias("resp_p"), "service", "orig_bytes", "resp_bytes")


@query("b1_device_filter", f"""WITH {A.EVENTS_SQL} SELECT uid, {r('t')} AS ts FROM conn WHERE device = 7""")
def _(spark, sf):
    c = text_logs.connections(text_logs.header_records(log_lines(spark, sf)), mac="00:00:00:00:00:07")
    return c.select("uid", "ts")


def json_text(spark: SparkSession, sf: str) -> DataFrame:
    """The events as JSON lines in files of their own, with notes, blanks and broken lines, read back."""
    body = F.to_json(F.struct("event_id", "event_type", "value"))
    value = F.when(F.col("event_id") % 10 == 0, "# note").when(F.col("event_id") % 10 == 1, "  ").when(
        F.col("event_id") % 10 == 2, F.substring(body, 1, 20)).otherwise(body)
    path = folder(spark, "json-lines")
    events = A.table(spark, sf, "events").withColumn("chunk", F.expr(f"event_id div {CHUNK}"))
    # a file per chunk: line n of it is the n-th event of the chunk
    events.repartition("chunk").sortWithinPartitions("chunk", "event_id").select("chunk", value.alias("value")).write.partitionBy("chunk").text(path)
    return text_logs.read_lines(spark, path).withColumn("file", F.regexp_extract("file", "(chunk=[^/]*)", 1))


EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@query("a3_json_lines", f"SELECT 'chunk=' || (event_id // {CHUNK}) AS file, event_id, event_type, {r('value')} AS value FROM events WHERE event_id % 10 > 2")
def _(spark, sf):
    return text_logs.json_lines(json_text(spark, sf), EVENT)[0]


@query("a3_bad_lines", f"""SELECT file, line FROM (SELECT event_id, 'chunk=' || (event_id // {CHUNK}) AS file,
    row_number() OVER (PARTITION BY event_id // {CHUNK} ORDER BY event_id) AS line FROM events) WHERE event_id % 10 = 2""")
def _(spark, sf):
    return text_logs.json_lines(json_text(spark, sf), EVENT)[1].select("file", "line")


def packets(spark: SparkSession, sf: str) -> DataFrame:
    return A.connections(spark, sf).select(F.col("event_id").alias("number"), F.col("ts").alias("timestamp"), F.col("orig_h").alias("source"),
                                           F.col("resp_h").alias("destination"), "proto", F.col("resp_p").alias("port"))


@query("a13_known_packets", f"""WITH {A.TELEMETRY_SQL}, kp AS (SELECT event_id AS number, t, orig_h AS source, resp_h AS destination FROM conn
    WHERE orig_h IN (SELECT ip FROM lease) OR resp_h IN (SELECT ip FROM lease))
  SELECT number, source, destination, {r('t - (SELECT t FROM kp ORDER BY number LIMIT 1)')} AS relative_time FROM kp""")
def _(spark, sf):
    kept, _skipped = files.known_packets(packets(spark, sf), A.leases(spark, sf))
    return kept.select("number", "source", "destination", "relative_time")


@query("a13_skipped_packets", f"""WITH {A.TELEMETRY_SQL} SELECT count(*) AS skipped FROM conn
  WHERE orig_h NOT IN (SELECT ip FROM lease) AND resp_h NOT IN (SELECT ip FROM lease)""")
def _(spark, sf):
    return files.known_packets(packets(spark, sf), A.leases(spark, sf))[1]


@query("a9_time_ordered_events", f"WITH {A.EVENTS_SQL} SELECT uid, orig_h, resp_h, {r('t')} AS timestamp FROM conn")
def _(spark, sf):
    path = f"{shared_dir(spark)}/dumps-{uuid.uuid4().hex}"
    rows = A.connections(spark, sf).select("uid", "orig_h", "resp_h", F.col("ts").alias("timestamp"), "event_type")
    rows.write.partitionBy("event_type").json(path)
    schema = "uid string, orig_h string, resp_h string, timestamp double"
    return files.merged_events(spark, [path], schema, array=False).select("uid", "orig_h", "resp_h", "timestamp")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a4_evaluation_records", f"SELECT event_id, event_type, {r('value')} AS value FROM events")
def _(spark, sf):
    path = folder(spark, "records")
    A.table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return files.evaluation_records(spark, path, EVENT, array=False)


FLOW = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("srcNumPackets", T.LongType()), T.StructField("flowDuration", T.DoubleType()),
                     T.StructField("ipProto", T.StringType())])
FLOW_SQL = f"SELECT event_id, ob AS \"srcNumPackets\", {r('value / 100')} AS \"flowDuration\", proto AS \"ipProto\" FROM conn"


@query("a5_flow_files", f"WITH {A.EVENTS_SQL} {FLOW_SQL}")
def _(spark, sf):
    path = folder(spark, "flow-files")
    A.connections(spark, sf).select("event_id", F.col("orig_bytes").alias("srcNumPackets"), (F.col("value") / 100).alias("flowDuration"),
                                    F.col("proto").alias("ipProto")).write.option("header", True).option("compression", "gzip").csv(path)
    return files.flow_files(spark, path, FLOW)[0].drop("file")


@query("a6_frozen_profile", ORACLES["d10_service_summary"])
def _(spark, sf):
    path = folder(spark, "profile")
    windows, shares, endpoints = behaviour.inputs(spark, sf)
    training = behaviour.training
    files.write_profile(profile.build_profile(training(windows), training(shares), training(endpoints)), path)
    return files.read_profile(spark, path, calibrated=False).services


SLICE = 1 << 14  # event ids that a document of a user spans


def sliced_documents(events: DataFrame, width: int = SLICE) -> DataFrame:
    """(user_id, slice, permissions): a user's events in documents that span ``width`` event ids each."""
    return events.groupBy("user_id", F.expr(f"event_id div {width}").alias("slice")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", "user_id", "value", F.expr(f"event_id div {width}").alias("slice")))).alias("permissions"))


def whole_ordinals(rows: DataFrame) -> DataFrame:
    """``ordinal`` within a user, from the place in the slice and the counts of the slices before it."""
    before = Window.partitionBy("user_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("user_id", "slice").agg(F.count("*").alias("n")).select(
        F.col("user_id").alias("u"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return rows.join(counts, F.col("user_id").eqNullSafe(F.col("u")) & F.col("slice").eqNullSafe(F.col("s"))) \
        .withColumn("ordinal", (F.col("ordinal") + F.col("earlier")).cast("int")).drop("u", "s", "earlier", "slice")


@query("a8_nested_lists", f"""SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS ordinal, event_id,
  {r('value')} AS value FROM events""")
def _(spark, sf):
    path = folder(spark, "policies")
    sliced_documents(A.table(spark, sf, "events")).write.json(path)
    schema = "permissions array<struct<event_id: bigint, user_id: bigint, value: double, slice: bigint>>"
    return whole_ordinals(files.nested_list(spark, path, schema, "permissions", lines=True))


@query("a10_stored_windows", f"WITH {A.EVENTS_SQL} SELECT device, ws AS window_start, count(*) AS flows FROM conn GROUP BY ALL")
def _(spark, sf):
    path = folder(spark, "windows")
    counts = A.telemetry(spark, sf).join(A.connections(spark, sf).select("uid", "device"), "uid").groupBy("device", "window_start").agg(F.count("*").alias("flows"))
    files.write_windows(counts, path)
    return spark.read.parquet(path).select("device", "window_start", "flows")


@query("a11_latest_snapshot", f"SELECT event_type, count(*) AS n, {r('max(value)')} AS top FROM events GROUP BY ALL")
def _(spark, sf):
    path = folder(spark, "snapshots")
    events = A.table(spark, sf, "events")
    summary = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    files.publish(summary(events.filter("event_id % 2 = 0")), path, 1)
    files.publish(summary(events), path, 2)
    return files.latest(spark, path)


@query("a12_event_log", f"WITH {A.EVENTS_SQL} SELECT {r('t')} AS recorded_at, event_type AS kind, uid AS trace_id, ob AS cents FROM conn")
def _(spark, sf):
    path = folder(spark, "log")
    rows = A.connections(spark, sf).select(F.col("ts").alias("recorded_at"), F.col("event_type").alias("kind"), F.col("uid").alias("decision_id"),
                                           F.col("orig_bytes").alias("cents"), "event_id")
    for half in (0, 1):
        files.append_events(files.event_records(rows.filter(f"event_id % 2 = {half}").drop("event_id"), ["decision_id", "cents"]), path)
    return spark.read.parquet(path).select("recorded_at", "kind", "trace_id", F.get_json_object("payload", "$.cents").cast("bigint").alias("cents"))
