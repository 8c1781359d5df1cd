"""The registered queries of this subpackage over the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxprint.llm import audit, darts, itq, kneser, langid, mixing, repeats, resampling, ring, templates, trust, warc, winnow
from fluxprint.llm.common import read, text_bytes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_ring_sharding")
def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: all shards of the ring end full, so that their counts differ by one at most."""
    raw = text_bytes(F.col("text"))
    digest = read(spark, sf_dir, "documents").select(
        "doc_id", (F.length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    return ring.bounded_ring(digest, tie="text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f"""


@query("op9_warc", WARC_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read(spark, sf_dir, "pages"))
    checked = back.withColumn("payload_digest", F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("digest does not match"))))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_template_decontamination")
def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op3_soft_mixing")
def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_kneser_ney_quality")
def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_dart_minhash")
def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return darts.classes(read(spark, sf_dir, "documents"))


@query("op7_itq")
def op7_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op1_link_trust")
def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.judged(read(spark, sf_dir, "pages"))


@query("op4_run_length_repeats")
def op4_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(read(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
first AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (len(ws) < 200)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INTEGER
    + 4 * (100 * len(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 3 * len(w.t))::INTEGER + 8 * regexp_matches(w.t, '[#$%&*|]')::INTEGER
    + 16 * coalesce(w.doc_id > m, false)::INTEGER AS bits
  FROM w JOIN first USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c,
    (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, i::INTEGER AS step, (1 << (ascii(filter_order[i]) - 65))::INTEGER AS bit,
    list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(filter_order[j]) - 65)))::INTEGER AS bf FROM o, range(1, 6) r(i)),
r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN bits & (coalesce(bf, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN bits & bit <> 0 AND bits & coalesce(bf, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN bits & bit <> 0 AND bits & coalesce(bf, 0) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN bits & bit <> 0 AND bits & coalesce(bf, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN bits & bit <> 0 AND bits & coalesce(bf, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


@query("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    combos = audit.combinations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return audit.interactions(combos).drop("filter")


RESAMPLING_SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc
    FROM range(256) r(b)),
texts AS (SELECT 0 AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (SELECT side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS feature FROM w),
n AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM n)),
b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
    lambda c, x: xor(c >> 8, tab.crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
nb AS (SELECT side, id, bucket, n FROM n JOIN b USING (feature)),
st AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM nb GROUP BY ALL),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM st) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM st) + 10000))))::BIGINT AS gain FROM st),
x AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM nb JOIN g USING (bucket) WHERE side = 0 GROUP BY ALL),
y AS (SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN x USING (id) WHERE side = 0),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 5 * (SELECT count(*) FROM y WHERE n_words >= 20) // 100 THEN k END AS "rank" FROM z"""


@query("op12_bit_sliced_resampling", RESAMPLING_SQL)
def op12_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_winnowing")
def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.neighbours(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", winnow.digests(F.col("marks")).alias("fingerprint"),
                       winnow.digests(F.col("edited_marks")).alias("edited_fingerprint"), "near_edited", "near_next")
