"""Recounts, residual scores, rollups, traffic calibration and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxprint.functions import scalars
from fluxprint.functions.scalars import bucket_start
from fluxprint.operators import calibration as K
from fluxprint.operators import device_features as D
from fluxprint.operators import evaluation, evidence, history, residuals, rollups, validation
from fluxprint.operators import policy as policy_ops
from fluxprint.plans import adapters as A
from fluxprint.plans import devices as V
from fluxprint.plans import policies as P
from fluxprint.plans.registry import query, r

W = A.WINDOW

# --- labelled records -------------------------------------------------------

RECORDS = """
rec AS (
  SELECT d.doc_id, h.head, CASE WHEN h.head = 'A' THEN quality ELSE toxic END AS label,
    CASE WHEN lang = 'de' THEN NULL WHEN h.head = 'A' THEN n_chars > 800 ELSE n_chars % 7 = 0 END AS flag, source <> 'src3' AS eligible,
    d.doc_id % 5 AS bucket, lang
  FROM documents d JOIN labels USING (doc_id), (VALUES ('A'), ('B')) h(head))"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Two detector heads over the labelled documents; German ones are unscored."""
    docs = A.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(A.table(spark, sf, "labels"), "doc_id").withColumn("head", F.explode(F.array(F.lit("A"), F.lit("B"))))
    a = F.col("head") == "A"
    return rows.select(
        "doc_id", "head", F.when(a, F.col("quality")).otherwise(F.col("toxic")).alias("label"),
        F.when(F.col("lang") != "de", F.when(a, F.col("n_chars") > 800).otherwise(F.col("n_chars") % 7 == 0)).alias("flag"),
        (F.col("source") != "src3").alias("eligible"), (F.col("doc_id") % 5).alias("bucket"), "lang")


@query("i1_detection", f"""WITH {RECORDS}, c AS (
  SELECT head, count(*) FILTER (WHERE eligible AND label = 1 AND flag) AS TP, count(*) FILTER (WHERE eligible AND label = 0 AND flag) AS FP,
    count(*) FILTER (WHERE eligible AND label = 0 AND NOT flag) AS TN, count(*) FILTER (WHERE eligible AND label = 1 AND NOT flag) AS FN,
    count(*) FILTER (WHERE eligible AND label = 1 AND flag IS NULL) AS unscored_positive,
    count(*) FILTER (WHERE eligible AND label = 0 AND flag IS NULL) AS unscored_negative,
    count(*) FILTER (WHERE eligible) AS population, count(*) FILTER (WHERE NOT eligible) AS excluded FROM rec GROUP BY head)
  SELECT *, {r('TP / nullif(TP + FP, 0)::DOUBLE')} AS precision, {r('TP / nullif(TP + FN + unscored_positive, 0)::DOUBLE')} AS population_recall,
    {r('2 * TP / nullif(2 * TP + FP + FN + unscored_positive, 0)::DOUBLE')} AS population_f1, {r('FP / nullif(FP + TN, 0)::DOUBLE')} AS fpr,
    {r('(TP + FP + TN + FN) / nullif(population, 0)::DOUBLE')} AS coverage FROM c""")
def _(spark, sf):
    return evaluation.detection(records(spark, sf), ["head"])


@query("i2_policy_confusion", f"""WITH {RECORDS}, p AS (
  SELECT lang, CASE WHEN doc_id % 4 < 2 THEN 'allowed' WHEN doc_id % 4 = 2 THEN 'denied' ELSE 'other' END AS e,
    CASE WHEN (doc_id + n_chars) % 4 < 2 THEN 'allowed' WHEN (doc_id + n_chars) % 4 = 2 THEN 'denied' ELSE 'unknown_device' END AS a
  FROM documents), c AS (
  SELECT lang, count(*) FILTER (WHERE e = 'denied' AND a = 'denied') AS TP, count(*) FILTER (WHERE e = 'allowed' AND a = 'denied') AS FP,
    count(*) FILTER (WHERE e = 'allowed' AND a = 'allowed') AS TN, count(*) FILTER (WHERE e = 'denied' AND a = 'allowed') AS FN,
    count(*) FILTER (WHERE e <> 'other') AS eligible, count(*) FILTER (WHERE e = 'other') AS unsupported,
    count(*) FILTER (WHERE e = 'denied' AND a = 'unknown_device') AS unavailable_forbidden,
    count(*) FILTER (WHERE e = 'allowed' AND a = 'unknown_device') AS unavailable_permitted, count(*) AS records FROM p GROUP BY lang)
  SELECT *, {r('(TP + FP + TN + FN) / records::DOUBLE')} AS binary_coverage_of_all_records,
    {r('(TP + TN) / nullif(TP + FP + TN + FN, 0)::DOUBLE')} AS agreement_on_scored_records FROM c""")
def _(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")

    def outcome(n, rest):
        return F.when(n % 4 < 2, "allowed").when(n % 4 == 2, "denied").otherwise(rest)

    rows = docs.select("lang", outcome(F.col("doc_id"), "other").alias("expected"),
                       outcome(F.col("doc_id") + F.col("n_chars"), "unknown_device").alias("actual"))
    return evaluation.policy_confusion(rows, ["lang"])


@query("i3_response_confusion", f"""WITH {RECORDS}
  SELECT head, count(*) FILTER (WHERE eligible AND label = 1 AND flag) AS TP, count(*) FILTER (WHERE eligible AND label = 0 AND flag) AS FP,
    count(*) FILTER (WHERE eligible AND label = 0 AND NOT flag) AS TN, count(*) FILTER (WHERE eligible AND label = 1 AND NOT flag) AS FN,
    count(*) FILTER (WHERE eligible AND flag IS NULL) AS unavailable, count(*) FILTER (WHERE NOT eligible) AS excluded,
    count(*) FILTER (WHERE eligible) AS population FROM rec GROUP BY head""")
def _(spark, sf):
    rows = records(spark, sf).select("head", (F.col("label") == 1).alias("required"), F.col("flag").alias("proposed"), "eligible")
    return evaluation.response_confusion(rows, ["head"])


ORACLE = f"""SELECT uid, ws, CASE WHEN a.device IS NULL THEN 'outside_household_origin' WHEN b.device IS NULL THEN 'unsupported_external_policy'
    WHEN EXISTS (SELECT 1 FROM perm p WHERE p.init = a.device AND p.resp = b.device AND p.proto = tele.proto AND p.resp_p = tele.resp_p)
    THEN 'allowed' ELSE 'denied' END AS expected
  FROM tele LEFT JOIN lease a ON a.ip = orig_h LEFT JOIN lease b ON b.ip = resp_h WHERE nf"""


def expected_permissions(spark: SparkSession, sf: str) -> DataFrame:
    flows = A.telemetry(spark, sf).filter("new_flow")
    return policy_ops.permission_oracle(flows, A.leases(spark, sf), P.permissions(spark, sf)).select(
        F.col("uid").alias("flow_uid"), "window_start", "expected")


@query("i4_permission_oracle", P.sql(f"SELECT uid AS flow_uid, ws AS window_start, expected FROM ({ORACLE})"))
def _(spark, sf):
    return expected_permissions(spark, sf)


@query("i12_permission_differences", P.sql(f"""SELECT flow_uid, window_start, expected AS recorded, permission AS recomputed
  FROM (SELECT uid AS flow_uid, ws AS window_start, expected FROM ({ORACLE})) JOIN outcome USING (flow_uid, window_start)
  WHERE expected <> permission"""))
def _(spark, sf):
    recorded = expected_permissions(spark, sf).withColumnRenamed("expected", "permission")
    return rollups.permission_differences(recorded, P.outcomes(spark, sf))


@query("i12_flag_totals", P.sql("""SELECT device, count(behavioral_score) AS scored_windows, count(*) FILTER (WHERE behavioral_flag)
  AS behavior_flags, count(*) FILTER (WHERE link_flag) AS connection_flags FROM score GROUP BY device"""))
def _(spark, sf):
    return rollups.flag_totals(P.scores(spark, sf))


PLAN = f"""
plan AS (
  SELECT event_id, 'r' || (device % 4) AS run_id, t, 'd' || (device % 4) AS actor, CASE WHEN k >= 40 THEN 'd' || (k - 40) END AS target,
    device % 4 < 2 AS rel, EXISTS (SELECT 1 FROM conn b WHERE b.event_type = 'error' AND b.device = a.device AND abs(b.t - a.t) <= {W}) AS found
  FROM conn a WHERE event_type = 'purchase')"""


def planned(spark: SparkSession, sf: str) -> DataFrame:
    """Planned events, found when an error of the same device lies close by."""
    from fluxprint.operators import matching

    c = A.connections(spark, sf).select("event_id", "device", "ts", "event_type", "k")
    hit = matching.band_match(c.filter("event_type = 'purchase'"), c.filter("event_type = 'error'"), ["device"], "ts", "ts", float(W), "event_id")
    n = (F.col("device") % 4).cast("string")
    return hit.select(F.concat(F.lit("r"), n).alias("run_id"), F.col("ts").alias("t"), F.concat(F.lit("d"), n).alias("actor"),
                      F.when(F.col("k") >= 40, F.concat(F.lit("d"), (F.col("k") - 40).cast("string"))).alias("target"),
                      (F.col("device") % 4 < 2).alias("relational"), "found")


@query("i6_truth_windows", f"""WITH {A.EVENTS_SQL}, {PLAN},
  e AS (SELECT run_id, (floor(t / {W}) * {W})::BIGINT AS ws, actor, rel, found, d AS device FROM plan, unnest([actor, target]) u(d) WHERE d IS NOT NULL),
  kn AS (SELECT run_id, device, ws AS window_start, CASE WHEN bool_or(found) THEN 1 ELSE -1 END AS behavior_label,
      CASE WHEN bool_or(rel AND device = actor) THEN CASE WHEN bool_or(found) THEN 1 ELSE -1 END ELSE 0 END AS relationship_label,
      CASE WHEN bool_or(device = actor) THEN 'actor' ELSE 'victim' END AS role FROM e GROUP BY ALL)
  SELECT * FROM kn UNION ALL
  SELECT a.run_id, a.actor, g.ws::BIGINT, -1, CASE WHEN rel THEN -1 ELSE 0 END, 'actor' FROM (SELECT DISTINCT run_id, actor, rel FROM plan) a,
    range({A.START + 2 * A.DAY}, {A.END}, {W}) g(ws)
  WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.run_id = a.run_id AND kn.device = a.actor AND kn.window_start = g.ws)""")
def _(spark, sf):
    p = planned(spark, sf)
    actors = p.select("run_id", "actor", "relational").distinct().withColumn("attack_start", F.lit(2 * A.DAY))
    return evaluation.truth_windows(p, actors, W, A.START, A.END)


@query("i6_observed_fraction", f"""WITH {A.EVENTS_SQL}, {PLAN} SELECT run_id, count(*) AS planned, count(*) FILTER (WHERE found) AS observed,
  {r('count(*) FILTER (WHERE found) / count(*)::DOUBLE')} AS observed_fraction,
  count(*) FILTER (WHERE found) / count(*)::DOUBLE >= 0.99 AS passed FROM plan GROUP BY run_id""")
def _(spark, sf):
    return evaluation.observed_fraction(planned(spark, sf))


# --- residuals and flags ----------------------------------------------------

EMBED = """
m AS (SELECT label, pos, avg(v) AS mu, stddev_pop(v) + 0.001 AS sd FROM (
  SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL),
s AS (SELECT vec_id, e.label, abs(v - mu) / sd AS z, pos FROM (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings) e JOIN m USING (label, pos))"""


def expected_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and spread per label and dimension, as one pair of arrays per label."""
    long = A.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    per = long.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("mu"), (F.stddev_pop(F.col("v").cast("double")) + 0.001).alias("sd"))
    # one entry per dimension of a vector
    packed = per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "sd"))).alias("p"))
    return packed.select("label", F.transform("p", lambda x: x["mu"]).alias("expected"), F.transform("p", lambda x: x["sd"]).alias("scale"))


def residual_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "embeddings").join(expected_vectors(spark, sf), "label")
    observed = F.transform("embedding", lambda v: v.cast("double"))
    return rows.withColumn("z", residuals.scaled_residuals(observed, F.col("expected"), F.col("scale")))


@query("h1_top_k_residual", f"""WITH {EMBED} SELECT vec_id, {r('avg(z)')} AS score FROM (
  SELECT vec_id, z, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC) AS n FROM s) WHERE n <= 3 GROUP BY vec_id""")
def _(spark, sf):
    return residual_scores(spark, sf).select("vec_id", residuals.top_k_mean(F.col("z")).alias("score"))


@query("h2_component_maximum", f"""WITH {EMBED}, c AS (
  SELECT vec_id, label, (SELECT avg(x) FROM (SELECT unnest(list_sort(list(z) FILTER (WHERE pos < half), 'DESC')[1:3]) AS x)) AS a,
    CASE WHEN vec_id % 5 <> 0 THEN (SELECT avg(x) FROM (SELECT unnest(list_sort(list(z) FILTER (WHERE pos >= half), 'DESC')[1:3]) AS x)) END AS b
  FROM (SELECT *, count(*) OVER (PARTITION BY vec_id) // 2 AS half FROM s) GROUP BY vec_id, label), n AS (SELECT label, avg(a) AS na, avg(b) AS nb FROM c GROUP BY label)
  SELECT vec_id, {r('greatest(a / na, b / nb)')} AS score FROM c JOIN n USING (label)""")
def _(spark, sf):
    rows = residual_scores(spark, sf).select(
        "vec_id", "label", residuals.top_k_mean(F.expr("slice(z, 1, size(z) div 2)")).alias("a"),
        F.when(F.col("vec_id") % 5 != 0, residuals.top_k_mean(F.expr("slice(z, size(z) div 2 + 1, size(z))"))).alias("b"))
    scale = rows.groupBy("label").agg(F.avg("a").alias("na"), F.avg("b").alias("nb"))
    return rows.join(scale, "label").select("vec_id", residuals.normalised_maximum(["a", "b"], ["na", "nb"]).alias("score"))


@query("h3_source_scores", V.sql(f"""SELECT c.device, c.ws AS window_start, {r('s')} AS score FROM cells c LEFT JOIN (
  SELECT source AS device, ws, max(ln(1 + ip_bytes)) AS s FROM ed GROUP BY ALL) USING (device, ws)"""))
def _(spark, sf):
    edges = V.edge_rows(spark, sf).select("window_start", F.col("source").alias("device"), F.log1p("ip_bytes").alias("score"))
    nodes = V.grid(spark, sf).filter("available").select("device", "window_start")
    return residuals.source_scores(edges, nodes, ["device", "window_start"])


@query("h4_strict_flags", V.sql(f"""SELECT device, ws AS window_start, CASE WHEN NOT available THEN 'unavailable' WHEN active_flows IS NULL THEN 'inactive'
  ELSE 'ok' END AS status, CASE WHEN available THEN {r('mean_observed_flow_duration')} END AS score,
  CASE WHEN available THEN mean_observed_flow_duration > 0.6 END AS flag,
  CASE WHEN NOT available OR active_flows IS NULL THEN 'inactive_or_unavailable' END AS reason
  FROM grid LEFT JOIN vol USING (device, ws)"""))
def _(spark, sf):
    m = V.minutes(spark, sf)
    rows = D.on_grid(m, D.volume(m))
    score = F.when(F.col("active_flows") > 0, F.col("mean_observed_flow_duration"))
    status = residuals.node_status(F.coalesce(F.col("active_flows") > 0, F.lit(False)), F.col("available"))
    return rows.select("device", "window_start", status.alias("status"), score.alias("score"),
                       residuals.strict_flag(score, F.lit(0.6)).alias("flag"), residuals.unscored_reason(score, "inactive_or_unavailable").alias("reason"))


RECORDED = """
bad AS (SELECT window_start, device, CASE WHEN n % 13 = 0 THEN NULL ELSE behavioral_score END AS behavioral_score,
    CASE WHEN n % 7 = 0 THEN NOT behavioral_flag ELSE behavioral_flag END AS behavioral_flag, link_anomaly, link_flag,
    CASE WHEN n % 17 = 0 THEN NULL ELSE 1.5 END AS threshold_a, 0.4 AS threshold_b, 'ok' AS status
  FROM (SELECT *, device[2:]::INT AS n FROM score))"""


def recorded_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as someone recorded them, with flipped flags and lost values."""
    n = F.substr("device", F.lit(2)).cast("int")
    return P.scores(spark, sf).withColumns({
        "behavioral_score": F.when(n % 13 != 0, F.col("behavioral_score")),
        "behavioral_flag": F.when(n % 7 == 0, ~F.col("behavioral_flag")).otherwise(F.col("behavioral_flag")),
        "threshold_a": F.when(n % 17 != 0, F.lit(1.5)), "threshold_b": F.lit(0.4)})


@query("h5_flag_errors", P.sql("""SELECT * FROM (
  SELECT window_start, device, 'a' AS head, CASE WHEN behavioral_score IS NULL THEN CASE WHEN behavioral_flag IS NOT NULL THEN 'flag_without_score' END
    WHEN threshold_a IS NULL THEN 'invalid_score_or_threshold' WHEN behavioral_flag <> (behavioral_score > threshold_a) THEN 'strict_cutoff_mismatch' END AS error FROM bad
  UNION ALL SELECT window_start, device, 'b', CASE WHEN link_anomaly IS NOT NULL AND link_flag <> (link_anomaly > threshold_b) THEN 'strict_cutoff_mismatch' END FROM bad)
  WHERE error IS NOT NULL""").replace("\nSELECT *", "," + RECORDED + "\nSELECT *", 1))
def _(spark, sf):
    return residuals.flag_errors(recorded_scores(spark, sf), [
        ("a", "behavioral_score", "behavioral_flag", "threshold_a"), ("b", "link_anomaly", "link_flag", "threshold_b")], ["window_start", "device"])


@query("h6_parity", P.sql("""SELECT window_start, device, 'missing' AS difference FROM score WHERE device[2:]::INT % 19 = 3
  UNION ALL SELECT window_start, device, 'behavioral_flag' FROM bad WHERE device[2:]::INT % 19 <> 3 AND device[2:]::INT % 7 = 0
  UNION ALL SELECT window_start, device, 'behavioral_score_availability' FROM bad WHERE device[2:]::INT % 19 <> 3 AND device[2:]::INT % 13 = 0"""
    ).replace("\nSELECT window_start", "," + RECORDED + "\nSELECT window_start", 1))
def _(spark, sf):
    actual = recorded_scores(spark, sf).filter(F.substr("device", F.lit(2)).cast("int") % 19 != 3)
    return residuals.parity(P.scores(spark, sf), actual, ["window_start", "device"], [
        ("behavioral_score", "behavioral_flag"), ("link_anomaly", "link_flag")])


# --- rollups ----------------------------------------------------------------

@query("i7_device_rollup", P.sql(f"""SELECT device, device AS name, device_type, coalesce(status, 'unavailable') AS status,
  CASE WHEN behavioral_flag OR link_flag THEN 'anomalous' WHEN status = 'ok' AND NOT behavioral_flag AND NOT link_flag THEN 'normal'
    WHEN status = 'ok' THEN 'monitoring' ELSE 'unscored' END AS risk, behavioral_score, link_anomaly, {r('last_seen')} AS last_seen,
  coalesce(allowed, 0) AS allowed, coalesce(denied, 0) AS denied, coalesce(unknown_policy, 0) AS unknown_policy, coalesce(unknown_device, 0) AS unknown_device
  FROM dev LEFT JOIN (SELECT * FROM score WHERE window_start = (SELECT max(window_start) FROM score)) USING (device)
  LEFT JOIN (SELECT d AS device, max(observed_at) AS last_seen FROM outcome, unnest([initiator_device_id, responder_device_id]) u(d)
    WHERE window_start = (SELECT max(window_start) FROM score) AND d IS NOT NULL GROUP BY ALL) USING (device)
  LEFT JOIN (SELECT initiator_device_id AS device, {', '.join(f"count(*) FILTER (WHERE permission = '{p}') AS {p}" for p in
    ('allowed', 'denied', 'unknown_policy', 'unknown_device'))} FROM outcome WHERE window_start = (SELECT max(window_start) FROM score) GROUP BY ALL)
    USING (device)"""))
def _(spark, sf):
    return rollups.device_rollup(A.devices(spark, sf), P.scores(spark, sf), P.outcomes(spark, sf))


@query("i8_relationship_rollup", P.sql(f"""SELECT coalesce(initiator_device_id, 'external:' || initiator_ip) AS source,
  coalesce(responder_device_id, 'external:' || responder_ip) AS target, o.proto, service_port AS port, count(*) AS count, sum(ob + rb)::BIGINT AS bytes,
  count(*) FILTER (WHERE permission = 'allowed') AS allowed, count(*) FILTER (WHERE permission = 'denied') AS denied,
  count(*) FILTER (WHERE starts_with(permission, 'unknown')) AS unknown, {r('max(observed_at)')} AS last_seen
  FROM outcome o JOIN tele ON uid = flow_uid WHERE window_start IN (SELECT DISTINCT window_start FROM outcome ORDER BY 1 DESC LIMIT 5) GROUP BY ALL"""))
def _(spark, sf):
    return rollups.relationship_rollup(P.outcomes(spark, sf), A.telemetry(spark, sf))


@query("c15_flow_bytes", P.sql("SELECT flow_uid, o.window_start, permission, ob + rb AS bytes FROM outcome o JOIN tele ON uid = flow_uid"))
def _(spark, sf):
    return rollups.with_flow_bytes(P.outcomes(spark, sf), A.telemetry(spark, sf)).select("flow_uid", "window_start", "permission", "bytes")


@query("i9_security_alerts", f"""WITH {A.EVENTS_SQL} SELECT proposal_id, max(window_start) AS window_start, max_by(reason, t) AS reason FROM (
  SELECT device || ':' || k % 10 AS proposal_id, floor(t)::BIGINT AS window_start, t, event_type AS reason FROM conn) GROUP BY proposal_id""")
def _(spark, sf):
    rows = A.connections(spark, sf).select(
        F.concat_ws(":", F.col("device").cast("string"), (F.col("k") % 10).cast("string")).alias("proposal_id"),
        F.floor("ts").cast("bigint").alias("window_start"), F.col("event_type").alias("reason"))
    return rollups.security_alerts(rows)


@query("i9_operations_alerts", f"""WITH {A.EVENTS_SQL} SELECT 'r' || device % 3 AS run_id, event_type AS text, count(*) AS occurrences,
  min(ws) AS first_window, max(ws) AS window_start FROM conn GROUP BY ALL""")
def _(spark, sf):
    rows = A.connections(spark, sf).select(F.concat(F.lit("r"), (F.col("device") % 3).cast("string")).alias("run_id"),
                                           F.col("event_type").alias("text"), bucket_start(F.col("ts"), W).alias("window_start"))
    return rollups.operations_alerts(rows)


@query("i9_limited_alerts", f"""WITH {A.EVENTS_SQL}, a AS (SELECT uid, ws AS window_start, ws = (SELECT max(ws) FROM conn) AS current FROM conn)
  SELECT * FROM a WHERE current UNION ALL SELECT uid, window_start, current FROM (
    SELECT *, row_number() OVER (ORDER BY window_start DESC, uid) AS n FROM a WHERE NOT current)
  WHERE n <= 100 - (SELECT count(*) FROM a WHERE current)""")
def _(spark, sf):
    rows = A.connections(spark, sf).select("uid", bucket_start(F.col("ts"), W).alias("window_start"))
    last = rows.agg(F.max("window_start").alias("m")).scalar()
    return rollups.limited_alerts(rows.withColumn("current", F.col("window_start") == last), 100, "uid")


KINDS = ["window", "gnn_evidence", "mud_evidence", "joined_evidence", "decision", "controller_outcome", "note"]
LOG = f"""
log AS (
  SELECT ({KINDS})[l_linenumber] AS kind, epoch_us(l_shipdate)::DOUBLE / 1000000 + l_linenumber / 10.0::DOUBLE AS recorded_at,
    CASE WHEN l_linenumber < 6 THEN 't' || l_orderkey END AS trace_id, CASE WHEN l_linenumber = 5 THEN 'x' || l_orderkey END AS decision_id,
    CASE WHEN l_linenumber >= 6 THEN 'x' || l_orderkey END AS request_decision_id, l_partkey::DOUBLE AS pk, l_suppkey AS sk, l_orderkey, l_linenumber
  FROM lineitem),
dec AS (SELECT decision_id AS d, max_by(trace_id, recorded_at) AS t FROM log WHERE kind = 'decision' GROUP BY ALL),
linked AS (SELECT log.* EXCLUDE (trace_id), coalesce(trace_id, t, 'unlinked') AS trace_id FROM log LEFT JOIN dec ON d = request_decision_id)"""


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as an event log: the line number gives the kind, late lines know only their decision."""
    line = F.col("l_linenumber")
    order = F.col("l_orderkey").cast("string")
    at = A.epoch(F.col("l_shipdate"))
    return A.table(spark, sf, "lineitem").select(
        F.get(F.array(*[F.lit(k) for k in KINDS]), line - 1).alias("kind"), (at + line / F.lit(10.0)).alias("recorded_at"),
        F.when(line < 6, F.concat(F.lit("t"), order)).alias("trace_id"), F.when(line == 5, F.concat(F.lit("x"), order)).alias("decision_id"),
        F.when(line >= 6, F.concat(F.lit("x"), order)).alias("request_decision_id"), F.col("l_partkey").cast("double").alias("window_end"),
        F.col("l_suppkey").cast("double").alias("first_flow"), F.col("l_suppkey").alias("flows"), F.col("l_suppkey").alias("flagged"),
        F.col("l_suppkey").alias("denied"), F.col("l_suppkey").alias("proposals"), F.col("l_partkey").cast("double").alias("installed_at"),
        "l_orderkey", "l_linenumber")


@query("c16_linked_traces", f"WITH {LOG} SELECT l_orderkey, l_linenumber, kind, trace_id FROM linked")
def _(spark, sf):
    return evidence.link_traces(event_log(spark, sf)).select("l_orderkey", "l_linenumber", "kind", "trace_id")


TRACES = LOG + """,
tr AS (
  SELECT trace_id, count(*) AS events, {at}, (max(struct_pack(a := recorded_at, b := pk)) FILTER (WHERE kind = 'window')).b AS window_end,
    (max(struct_pack(a := recorded_at, b := sk::DOUBLE)) FILTER (WHERE kind = 'window')).b AS first_flow, (max(struct_pack(a := recorded_at, b := sk)) FILTER (WHERE kind = 'window')).b AS flows,
    (max(struct_pack(a := recorded_at, b := sk)) FILTER (WHERE kind = 'gnn_evidence')).b AS flagged, (max(struct_pack(a := recorded_at, b := sk)) FILTER (WHERE kind = 'mud_evidence')).b AS denied,
    (max(struct_pack(a := recorded_at, b := sk)) FILTER (WHERE kind = 'decision')).b AS proposals, (max(struct_pack(a := recorded_at, b := pk)) FILTER (WHERE kind = 'controller_outcome')).b AS installed_at
  FROM linked GROUP BY trace_id HAVING trace_id <> 'unlinked' OR count(*) FILTER (WHERE kind = 'window') > 0)""".format(
    at=", ".join(f"max(recorded_at) FILTER (WHERE kind = '{k}') AS {k}_at" for k in KINDS[:6]))


@query("c17_traces", f"""WITH {TRACES} SELECT trace_id, events, {', '.join(f'{r(k + "_at")} AS {k}_at' for k in KINDS[:6])}, window_end, first_flow,
  flows, flagged, denied, proposals, installed_at, {r('window_end - first_flow')} AS packet_to_window_close,
  {r('joined_evidence_at - window_end')} AS window_close_to_join, {r('decision_at - joined_evidence_at')} AS join_to_decision,
  {r('installed_at - decision_at')} AS decision_to_install, {r('installed_at - first_flow')} AS packet_to_install FROM tr""")
def _(spark, sf):
    return evidence.assemble_traces(evidence.link_traces(event_log(spark, sf)))


@query("i10_action_lifecycle", """SELECT l_orderkey AS decision_id, max(struct_pack(a := t, b := s)).b AS status, max(t) AS updated_at, count(*) AS changes,
  string_agg(s, '>' ORDER BY t, s) AS lifecycle FROM (SELECT l_orderkey, l_returnflag || l_linestatus || l_linenumber AS s,
    epoch_us(l_shipdate)::DOUBLE / 1000000 + l_linenumber / 1000.0::DOUBLE AS t FROM lineitem) GROUP BY ALL""".replace("max(t) AS updated_at", r("max(t)") + " AS updated_at"))
def _(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("decision_id"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("status"),
        (A.epoch(F.col("l_shipdate")) + F.col("l_linenumber") / F.lit(1000.0)).alias("recorded_at"))
    return rollups.action_lifecycle(rows)


@query("i11_overview", P.sql(f"""SELECT (SELECT count(*) FROM dev) AS devices, (SELECT count(*) FROM lst) AS active_devices,
  (SELECT count(*) FROM lst WHERE behavioral_flag OR link_flag) AS anomalous_devices, count(*) AS windows,
  count(*) FILTER (WHERE rp > 1 AND failed IS FALSE) AS healthy_windows, count(t) AS timed_windows, {r('median(t - ws)')} AS p50_window_to_join,
  {r('list_sort(list(t - ws))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1]')} AS p95_window_to_join,
  {r(f'greatest(0, {A.END + 100}.0::DOUBLE - max(ws + {W}))')} AS observation_age_seconds, {A.END + 100} - max(ws + {W}) <= 180 AS evidence_fresh
  FROM tele""").replace("\nSELECT (SELECT count(*) FROM dev)", """,
lst AS (SELECT * FROM score WHERE window_start = (SELECT max(window_start) FROM score))
SELECT (SELECT count(*) FROM dev)""", 1))
def _(spark, sf):
    devices = rollups.device_rollup(A.devices(spark, sf), P.scores(spark, sf), P.outcomes(spark, sf))
    windows = A.telemetry(spark, sf).select(
        (F.col("flow_start") - F.col("window_start")).alias("window_close_to_join"), (F.col("window_start") + W).alias("window_end"),
        F.when(F.col("resp_pkts") > 1, "healthy").otherwise("unhealthy").alias("sensor"), F.col("failed").alias("partial"))
    return rollups.overview(devices, windows, float(A.END + 100))


@query("i13_latency_percentiles", f"""SELECT l_shipmode AS grp, count(*) AS n,
  {r('list_sort(list(v))[floor(0.5::DOUBLE * (count(*) - 1))::BIGINT + 1]')} AS p50,
  {r('list_sort(list(v))[floor(0.95::DOUBLE * (count(*) - 1))::BIGINT + 1]')} AS p95, {r('max(v)')} AS max
  FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice AS v FROM lineitem) GROUP BY ALL""")
def _(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v"))
    return rollups.latency_percentiles(rows, ["grp"], "v")


@query("g9_drop_deltas", f"""WITH {A.EVENTS_SQL}, h AS (SELECT device, ws AS window_start, max(event_id) AS dropped_total FROM conn GROUP BY ALL)
  SELECT *, dropped_total - coalesce(lag(dropped_total) OVER (PARTITION BY device ORDER BY window_start), 0) AS capture_drops FROM h""")
def _(spark, sf):
    c = A.connections(spark, sf)
    health = c.groupBy("device", bucket_start(F.col("ts"), W).alias("window_start")).agg(F.max("event_id").alias("dropped_total"))
    return rollups.drop_deltas(health, ["device"])


@query("g10_run_check", f"""WITH {A.EVENTS_SQL}, h AS (
    SELECT device, ws, bool_and(event_type <> 'error') AS c, row_number() OVER (PARTITION BY device ORDER BY ws DESC) AS n FROM conn GROUP BY device, ws)
  SELECT device, count(*) AS windows, max(ws) - min(ws) = {W} * (count(*) - 1) AS consecutive, bool_and(c) AS all_complete,
    {A.END} - max(ws + {W}) < 86400 AS fresh, count(*) >= 2 AS enough FROM h WHERE n <= 2 GROUP BY device""")
def _(spark, sf):
    c = A.connections(spark, sf)
    rows = c.groupBy("device", bucket_start(F.col("ts"), W).alias("window_start")).agg(
        F.every(F.col("event_type") != "error").alias("complete")).withColumn("window_end", F.col("window_start") + W)
    return rollups.run_check(rows, ["device"], W, 2, F.lit(A.END), 86400)


@query("g11_score_history", P.sql("""SELECT device, window_start, behavioral_score, behavioral_flag, link_anomaly, link_flag, status, age::INTEGER AS age FROM (
  SELECT *, row_number() OVER (PARTITION BY device ORDER BY window_start DESC) AS age FROM score) WHERE age <= 60"""))
def _(spark, sf):
    return history.last_scores(P.scores(spark, sf), ["device"], "window_start")


@query("g11_last_valid", P.sql("""SELECT device, max_by(behavioral_score, window_start) AS last_behavioral_score,
  max_by(behavioral_flag, window_start) AS last_behavioral_flag, max(window_start) AS last_behavioral_score_at,
  max_by(link_anomaly, window_start) FILTER (WHERE link_flag IS NOT NULL) AS last_link_anomaly,
  max_by(link_flag, window_start) FILTER (WHERE link_flag IS NOT NULL) AS last_link_flag,
  max(window_start) FILTER (WHERE link_flag IS NOT NULL) AS last_link_anomaly_at FROM score GROUP BY device"""))
def _(spark, sf):
    return history.last_valid(P.scores(spark, sf), ["device"], "window_start", [("behavioral_score", "behavioral_flag"), ("link_anomaly", "link_flag")])


# --- traffic calibration ----------------------------------------------------

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("j2_numeric_summary", "\nUNION ALL ".join(f"""SELECT l_returnflag AS device, '{c}' AS feature, count(*) AS count, {r(f'avg({c})')} AS mean,
  {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'quantile_cont({c}, 0.25)')} AS q1,
  {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q3,
  {r(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} AS iqr FROM lineitem GROUP BY l_returnflag""" for c in NUMERIC))
def _(spark, sf):
    return K.numeric_summary(A.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "device"), ["device"], NUMERIC)


@query("j3_value_shares", f"""SELECT device, value, n, {r('n / sum(n) OVER (PARTITION BY device)')} AS share FROM (
  SELECT l_suppkey AS device, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL)""")
def _(spark, sf):
    return K.value_shares(A.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "device"), ["device"], "l_returnflag")


@query("j3_top_values", f"""SELECT device, value, n, {r('n / total')} AS share FROM (
  SELECT *, sum(n) OVER (PARTITION BY device) AS total, row_number() OVER (PARTITION BY device ORDER BY n DESC, value) AS rn FROM (
    SELECT l_returnflag AS device, l_suppkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rn <= 10""")
def _(spark, sf):
    return K.value_shares(A.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "device"), ["device"], "l_suppkey", 10)


@query("j4_destinations", f"""SELECT l_suppkey AS device, count(*) AS distinct_destinations, sum(n)::BIGINT AS flows,
  {r('count(*) FILTER (WHERE n = 1) / sum(n)')} AS singleton_share FROM (
  SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def _(spark, sf):
    return K.destination_summary(A.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "device"), ["device"], "l_partkey")


DAYS = f"""
hrs AS (SELECT event_type AS device, (t // 86400)::BIGINT AS day, ((t % 86400) // 3600)::INTEGER AS hour FROM (SELECT event_type, floor(t)::BIGINT AS t FROM conn)),
dh AS (SELECT device, day, hour, count(*) AS n FROM hrs GROUP BY ALL),
dd AS (SELECT device, day, sum(n)::BIGINT AS flows, max(n) AS peak FROM dh GROUP BY ALL),
md AS (SELECT device, median(flows) AS med FROM dd GROUP BY ALL),
dq2 AS (SELECT dd.*, med, flows < 50 AS few, flows < 0.2 * med AS sparse, peak / flows::DOUBLE > 0.5 AS peaked FROM dd JOIN md USING (device))"""


def days(spark: SparkSession, sf: str) -> DataFrame:
    c = A.connections(spark, sf)
    return K.day_hours(c.select(F.col("event_type").alias("device"), F.floor(F.col("ts") / 86400).cast("bigint").alias("day"),
                                scalars.utc_hour(F.col("ts")).alias("hour")))


@query("j5_active_hours", f"""WITH {A.EVENTS_SQL}, {DAYS}
  SELECT u.device, (SELECT count(*) FROM dq2 q WHERE q.device = u.device AND NOT (few OR sparse OR peaked)) AS days_used, h.hour::INTEGER AS hour,
    {r('median(coalesce(n, 0) / flows::DOUBLE)')} AS share, median(coalesce(n, 0) / flows::DOUBLE) >= 1 / 48.0::DOUBLE AS active
  FROM dq2 u CROSS JOIN range(24) h(hour) LEFT JOIN dh ON dh.device = u.device AND dh.day = u.day AND dh.hour = h.hour
  WHERE NOT (few OR sparse OR peaked) GROUP BY u.device, h.hour""")
def _(spark, sf):
    return K.robust_active_hours(days(spark, sf))


@query("j6_day_quality", f"""WITH {A.EVENTS_SQL}, {DAYS}
  SELECT device, day, flows, {r('peak / flows::DOUBLE')} AS peak_share, CASE WHEN few OR sparse OR peaked THEN
    concat_ws(';', CASE WHEN few THEN 'low_flow_count' WHEN sparse THEN 'low_relative_to_median' END, CASE WHEN peaked THEN 'concentrated_in_one_hour' END)
    WHEN dev < 0.02 THEN 'flat' ELSE 'peaked' END AS status
  FROM dq2 JOIN (SELECT d.device, d.day, max(abs(coalesce(n, 0) / flows::DOUBLE - 1 / 24.0::DOUBLE)) AS dev FROM dd d CROSS JOIN range(24) h(hour)
    LEFT JOIN dh ON dh.device = d.device AND dh.day = d.day AND dh.hour = h.hour GROUP BY ALL) USING (device, day)""")
def _(spark, sf):
    return K.day_quality(days(spark, sf))


UNIT = "CASE l_returnflag WHEN 'A' THEN 1000000000 WHEN 'N' THEN 1000 ELSE 1 END"


@query("b14_epoch_units", f"""SELECT l_orderkey, l_linenumber, {r('epoch_us(l_shipdate)::DOUBLE / 1000000', 3)} AS ts FROM lineitem""", digits=3)
def _(spark, sf):
    flag = F.col("l_returnflag")
    rows = A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", flag.alias("file"), (A.epoch(F.col("l_shipdate")) * F.when(flag == "A", 1e9).when(flag == "N", 1e3)
                                                           .otherwise(1.0)).alias("time"))
    return K.epoch_seconds(rows, "time").select("l_orderkey", "l_linenumber", "ts")


@query("b15_device_from_file", f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'cam_a' ELSE 'cam' || (o_orderkey % 10) END AS device FROM orders""")
def _(spark, sf):
    n = F.col("o_orderkey")
    base = F.concat(F.lit("cam"), (n % 10).cast("string"))
    name = (F.when(n % 4 == 0, F.concat(base, F.lit("_2016-09-23.csv"))).when(n % 4 == 1, F.concat(base, F.lit("-DAY3.csv")))
            .when(n % 4 == 2, F.lit("data/cam_a_part2.csv")).otherwise(F.concat(base, F.lit("-12.csv"))))
    return A.table(spark, sf, "orders").select("o_orderkey", scalars.device_from_file(name).alias("device"))


# --- scalar expressions -----------------------------------------------------

@query("b4_b5_b7_names", """SELECT page_id, NOT (ends_with(n, '.local') OR ends_with(n, '.arpa')) AS endpoint,
  n NOT LIKE '% %' AND regexp_full_match(n, '.*\\.[a-z]{2,}') AS hostname,
  CASE WHEN page_id % 3 <> 2 THEN lower(m[1:2] || ':' || m[3:4] || ':' || m[5:6] || ':' || m[7:8] || ':' || m[9:10] || ':' || m[11:12]) END AS mac
  FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN split_part(url, '/', 3) WHEN 1 THEN 'printer.local' WHEN 2 THEN '1.0.in-addr.arpa'
    ELSE 'a b.example.com' END AS n, lpad(to_hex(page_id), 12, '0') AS m FROM pages)""")
def _(spark, sf):
    n = F.col("page_id")
    name = (F.when(n % 4 == 0, F.element_at(F.split("url", "/"), 3)).when(n % 4 == 1, "printer.local").when(n % 4 == 2, "1.0.in-addr.arpa")
            .otherwise("a b.example.com"))
    hexed = F.lpad(F.hex(n), 12, "0")
    device = F.when(n % 3 == 0, F.concat(F.lit("Cam_"), hexed)).when(n % 3 == 1, F.concat(F.lit("Cam_x_"), hexed, F.lit(".pcap"))).otherwise("Cam_nomac")
    return A.table(spark, sf, "pages").select("page_id", scalars.is_endpoint_domain(name).alias("endpoint"),
                                              scalars.looks_like_hostname(name).alias("hostname"), scalars.mac_from_name(device).alias("mac"))


@query("b8_b9_service_keys", f"""SELECT category, key, node, count(*) AS n FROM (
  SELECT {V.category('proto', 'port')} AS category, proto || '/' || port AS key, 'external_service:' || {V.category('proto', 'port')} AS node FROM (
    SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'udp' WHEN l_linenumber % 3 = 1 THEN 'tcp' END AS proto,
      ([53, 80, 8080, 9090, 443, 8443, 123, 1900, 5353, 1883, 8883, 5683, 7])[l_partkey % 14 + 1] AS port FROM lineitem)) GROUP BY ALL""")
def _(spark, sf):
    line = F.col("l_linenumber")
    ports = F.array(*[F.lit(p) for p in [53, 80, 8080, 9090, 443, 8443, 123, 1900, 5353, 1883, 8883, 5683, 7]])
    rows = A.table(spark, sf, "lineitem").select(F.when(line % 3 == 0, "udp").when(line % 3 == 1, "tcp").alias("proto"),
                                                 F.get(ports, (F.col("l_partkey") % 14).cast("int")).alias("port"))
    p, q = F.col("proto"), F.col("port")
    return rows.groupBy(scalars.service_category(p, q).alias("category"), scalars.port_key(p, q).alias("key"),
                        scalars.external_node(p, q).alias("node")).agg(F.count(F.lit(1)).alias("n"))


@query("b11_b12_b13_encodings", f"""WITH {A.EVENTS_SQL} SELECT event_id, {r('ln(1 + ob) - ln(1 + rb)')} AS log_ratio, {r('exp(ln(1 + value)) - 1')} AS back,
  {r('asinh(value)')} AS squashed, {r('greatest(-8, least(8, (value - 50) / 5))')} AS clipped, {r('sin(2 * pi() * ((floor(t) + 3600) % 86400) / 86400)')} AS time_sin,
  {r('cos(2 * pi() * ((floor(t) + 3600) % 86400) / 86400)')} AS time_cos, (event_type = 'click')::INT AS is_click, (event_type = 'view')::INT AS is_view FROM conn""")
def _(spark, sf):
    angle = scalars.day_angle(F.floor("ts"), F.lit(3600))
    return A.connections(spark, sf).select(
        "event_id", scalars.signed_log_ratio(F.col("orig_bytes"), F.col("resp_bytes")).alias("log_ratio"), F.expm1(F.log1p("value")).alias("back"),
        F.asinh("value").alias("squashed"), scalars.clip((F.col("value") - 50) / 5, -8.0, 8.0).alias("clipped"), F.sin(angle).alias("time_sin"),
        F.cos(angle).alias("time_cos"), *scalars.one_hot(F.col("event_type"), ["click", "view"], "is_"))


@query("b17_display_names", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Amazon Echo' WHEN 1 THEN 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0')
  WHEN 2 THEN 'Smart Door Lock' ELSE 'Unknown device' END AS name FROM customer""")
def _(spark, sf):
    n = F.col("c_custkey")
    raw = (F.when(n % 4 == 0, F.concat(F.lit("AmazonEcho_"), n.cast("string"))).when(n % 4 == 1, F.col("c_name"))
           .when(n % 4 == 2, F.lit("SmartDoorLock_x_y")))
    return A.table(spark, sf, "customer").select("c_custkey", scalars.display_name(raw).alias("name"))


# --- data quality -----------------------------------------------------------

FAULTS = f"""
ft AS (
  SELECT uid, CASE WHEN k = 13 THEN ws + 7 ELSE ws END AS window_start, CASE WHEN k = 23 THEN '10.0.0.300' ELSE orig_h END AS orig_h,
    CASE WHEN k = 17 THEN -1 ELSE ob END AS ob, CASE WHEN k = 19 THEN 70000 ELSE resp_p END AS resp_p, CASE WHEN k = 29 THEN NULL ELSE proto END AS proto,
    event_type = 'error' AS failed, k = 31 AS est, k <> 37 AND event_type <> 'signup' AS syn, t, k FROM conn)"""


def faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry with faults planted where the event's key says so."""
    k = A.connections(spark, sf).select("uid", "k")
    t = A.telemetry(spark, sf).join(k, "uid")
    return t.withColumns({
        "window_start": F.when(F.col("k") == 13, F.col("window_start") + 7).otherwise(F.col("window_start")),
        "orig_h": F.when(F.col("k") == 23, "10.0.0.300").otherwise(F.col("orig_h")),
        "orig_ip_bytes": F.when(F.col("k") == 17, -1).otherwise(F.col("orig_ip_bytes")),
        "resp_p": F.when(F.col("k") == 19, 70000).otherwise(F.col("resp_p")), "proto": F.when(F.col("k") != 29, F.col("proto")),
        "established": F.col("k") == 31, "tcp_syn_observed": (F.col("k") != 37) & (F.col("proto") == "tcp")})


@query("l1_telemetry_rules", f"""WITH {A.EVENTS_SQL}, {FAULTS}
  SELECT uid, window_start, 'unaligned_window' AS rule FROM ft WHERE window_start % {W} <> 0
  UNION ALL SELECT uid, window_start, 'invalid_orig_h' FROM ft WHERE k = 23 UNION ALL SELECT uid, window_start, 'negative_orig_ip_bytes' FROM ft WHERE ob < 0
  UNION ALL SELECT uid, window_start, 'invalid_resp_p' FROM ft WHERE resp_p > 65535 UNION ALL SELECT uid, window_start, 'missing_proto' FROM ft WHERE proto IS NULL
  UNION ALL SELECT uid, window_start, 'failed_and_established' FROM ft WHERE failed AND est
  UNION ALL SELECT uid, window_start, 'failed_without_syn' FROM ft WHERE failed AND NOT syn""")
def _(spark, sf):
    return validation.telemetry(faulty(spark, sf), W)


@query("l2_inventory_rules", P.sql("""SELECT device, 'duplicate_device' AS rule FROM dev WHERE id % 6 = 0
  UNION ALL SELECT d.device, 'unknown_type' FROM dev d, range(2) x(i) WHERE id % 8 = 1 AND (i = 0 OR id % 6 = 0)
  UNION ALL SELECT d.device, 'no_identity' FROM dev d, range(2) x(i) WHERE id % 7 = 3 AND id % 2 = 1 AND (i = 0 OR id % 6 = 0)
  UNION ALL SELECT device, 'invalid_lease' FROM dev WHERE id % 7 <> 3 AND id % 5 = 2"""))
def _(spark, sf):
    n = F.col("id")
    d = A.devices(spark, sf)
    d = d.unionByName(d.filter(n % 6 == 0)).withColumn("device_type", F.when(n % 8 == 1, "toaster").otherwise(F.col("device_type")))
    d = d.withColumn("mac", F.when(n % 2 == 0, F.col("mac")))
    leases = A.leases(spark, sf)
    m = F.substr("device", F.lit(2)).cast("int")
    leases = leases.withColumn("lease_end", F.when(m % 5 == 2, F.col("lease_start")).otherwise(F.col("lease_end")))
    return validation.inventory(d.drop("id"), leases, A.START, A.END, W)


@query("l3_label_rules", f"""WITH {A.EVENTS_SQL}, {P.LABELS}
  SELECT label_id, device, 'outside_capture' AS rule FROM lb WHERE e > {A.END} UNION ALL SELECT label_id, device, 'unknown_device' FROM lb WHERE device % 5 = 0
  UNION ALL SELECT label_id, device, 'positive_not_actor' FROM lb WHERE label = 1 AND k % 3 = 0
  UNION ALL SELECT label_id, device, 'positive_without_onset' FROM lb WHERE label = 1 AND k % 4 = 0
  UNION ALL SELECT label_id, device, 'no_evidence' FROM lb WHERE k % 9 = 0
  UNION ALL SELECT label_id, device, 'interval_outside_label' FROM lb WHERE k % 2 = 1""")
def _(spark, sf):
    rows = P.label_rows(spark, sf)
    k = F.col("k")
    rows = rows.withColumns({"role": F.when(k % 3 == 0, "victim").otherwise("actor"), "onset": F.when(k % 4 != 0, "later"),
                             "evidence": F.when(k % 9 == 0, "").otherwise("capture"), "attack_family": F.lit("scan")})
    nested = rows.filter(k % 2 == 1).select("label_id", (F.col("start") - 1).alias("start"), (F.col("start") + 60).alias("end"))
    known = rows.select("device").distinct().filter(F.col("device") % 5 != 0)
    return validation.labels(rows, known, A.START, A.END, nested)


SPANS = f"""
sp AS (SELECT event_id AS binding_id, device, '10.1.0.' || (k % 50) AS ip, floor(t)::BIGINT AS vf, floor(t)::BIGINT + 3600 AS vu FROM conn WHERE event_type = 'click')"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    start = F.floor("ts").cast("bigint")
    return A.connections(spark, sf).filter("event_type = 'click'").select(
        F.col("event_id").alias("binding_id"), F.col("device").cast("string").alias("device"), F.concat(F.lit("10.1.0."), (F.col("k") % 50).cast("string")).alias("ip"),
        F.col("device").cast("string").alias("mac"), (F.col("k") % 50 + 1).cast("int").alias("switch_port"), start.alias("valid_from"),
        (start + 3600).alias("valid_until"))


@query("l4_ambiguous_ownership", f"""WITH {A.EVENTS_SQL}, {SPANS}
  SELECT DISTINCT a.ip, 'ambiguous_ip_ownership' AS rule FROM sp a JOIN sp b ON a.ip = b.ip AND a.device <> b.device AND a.vf < b.vu AND b.vf < a.vu""")
def _(spark, sf):
    leases = spans(spark, sf).withColumnsRenamed({"valid_from": "lease_start", "valid_until": "lease_end"})
    return validation.ambiguous_ownership(leases).select("ip", "rule").distinct()


@query("l4_window_rules", f"""WITH {A.EVENTS_SQL}, o AS (SELECT device AS sensor_id, ws AS window_start, bool_or(event_type = 'click') AS c, max(t) AS wm FROM conn GROUP BY ALL)
  SELECT sensor_id, window_start, 'complete_without_watermark' AS rule FROM o WHERE c AND wm + 10800 < window_start + {W}
  UNION ALL SELECT sensor_id, window_start, 'not_closed' FROM o WHERE window_start + {W} > {A.END - A.DAY} + 2""")
def _(spark, sf):
    g = A.connections(spark, sf).groupBy(F.col("device").alias("sensor_id"), bucket_start(F.col("ts"), W).alias("window_start")).agg(
        F.bool_or(F.col("event_type") == "click").alias("complete"), (F.max("ts") + 10800).alias("watermark"))
    return validation.windows(g.withColumn("window_end", F.col("window_start") + W), float(A.END - A.DAY), window=W)


@query("l5_binding_rules", f"""WITH {A.EVENTS_SQL}, {SPANS}
  SELECT DISTINCT a.device::VARCHAR AS device, NULL AS resource, 'overlapping_bindings' AS rule FROM sp a JOIN sp b
    ON a.device = b.device AND a.binding_id <> b.binding_id AND a.vf < b.vu AND b.vf < a.vu
  UNION ALL SELECT DISTINCT NULL, a.ip, 'shared_ip' FROM sp a JOIN sp b ON a.ip = b.ip AND a.device <> b.device AND a.vf < b.vu AND b.vf < a.vu
  UNION ALL SELECT DISTINCT NULL, (split_part(a.ip, '.', 4)::INT + 1)::VARCHAR, 'shared_switch_port' FROM sp a JOIN sp b
    ON a.ip = b.ip AND a.device <> b.device AND a.vf < b.vu AND b.vf < a.vu
  UNION ALL SELECT device::VARCHAR, NULL, 'outside_subnet' FROM sp WHERE split_part(ip, '.', 4)::INT >= 32""")
def _(spark, sf):
    return validation.bindings(spans(spark, sf), "10.1.0.0/27")


@query("l6_policy_rules", P.sql("""SELECT init AS initiator, 'duplicate_permission' AS rule FROM perm WHERE init[2:]::INT % 3 = 0
  UNION ALL SELECT device, 'network_or_name_required' FROM dev WHERE id % 4 = 0 UNION ALL SELECT device, 'unknown_initiator' FROM dev, range(2) x(i)
    WHERE id % 5 = 0 AND (i = 0 OR id % 2 = 0)
  UNION ALL SELECT device, 'invalid_port' FROM dev WHERE id % 2 = 0 AND id % 7 = 0"""))
def _(spark, sf):
    p = P.permissions(spark, sf)
    n = F.substr("initiator", F.lit(2)).cast("int")
    e = P.external_rules(spark, sf)
    e = e.withColumns({"fqdn": F.when(F.col("network").isNotNull() & (n % 4 == 0), "x.example.net").otherwise(F.col("fqdn")),
                       "service_port": F.when(F.col("network").isNotNull() & (n % 7 == 0), 0).otherwise(F.col("service_port"))})
    return validation.policy(p.unionByName(p.filter(n % 3 == 0)), e, A.devices(spark, sf).filter(F.col("id") % 5 != 0))


@query("l7_profile_rules", V.sql("""SELECT device, direction, 'counts_do_not_sum' AS rule FROM tot WHERE device[2:]::INT % 3 = 0
  UNION ALL SELECT device, direction, 'invalid_total' FROM tot WHERE device[2:]::INT % 10 = 0 AND direction = 'in'
  UNION ALL SELECT device, direction, 'counts_do_not_sum' FROM tot WHERE device[2:]::INT % 3 <> 0 AND device[2:]::INT % 10 = 0 AND direction = 'in'"""))
def _(spark, sf):
    counts = D.flow_profile(D.peer_services(V.minutes(spark, sf)).filter(F.col("window_start") < A.TRAIN_END))
    n = F.substr("device", F.lit(2)).cast("int")
    totals = counts.groupBy("device", "direction").agg(F.sum("seen").alias("total"))
    totals = totals.withColumn("total", F.when((n % 10 == 0) & (F.col("direction") == "in"), -1).when(n % 3 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return validation.flow_profile(counts, totals)


@query("l8_causality", """SELECT conv_id, turn, 'future_history' AS rule FROM conversations WHERE turn % 3 = 2
  UNION ALL SELECT conv_id, turn, 'other_run' FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 'duplicate_history' FROM (
    SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN turn + 1 ELSE turn - 1 END AS prior, count(*) AS n FROM conversations GROUP BY ALL) WHERE n > 1""")
def _(spark, sf):
    c = A.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.col("turn") + 1).otherwise(F.col("turn") - 1).alias("prior_start"),
        F.lit("a").alias("run_id"), F.when(F.col("role") == "assistant", "b").otherwise("a").alias("prior_run_id"))
    return validation.causality(c, current="turn", keys=["conv_id"])


@query("l9_interval_rows", f"""WITH {A.EVENTS_SQL} SELECT DISTINCT uid, ws AS window_start, 'duplicate_interval' AS rule FROM conn WHERE k = 5
  UNION ALL SELECT uid, ws, 'before_capture' FROM conn WHERE ws < {A.START + A.DAY} UNION ALL SELECT uid, ws, 'before_capture' FROM conn WHERE ws < {A.START + A.DAY} AND k = 5
  UNION ALL SELECT uid, ws, 'after_capture' FROM conn WHERE ws >= {A.END - A.DAY} UNION ALL SELECT uid, ws, 'after_capture' FROM conn WHERE ws >= {A.END - A.DAY} AND k = 5""")
def _(spark, sf):
    c = A.connections(spark, sf).select("uid", bucket_start(F.col("ts"), W).alias("window_start"), "k")
    return validation.interval_rows(c.unionByName(c.filter("k = 5")), A.START + A.DAY, A.END - A.DAY)
