"""Who owns an address when: leases, bindings, inventory, name evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxprint.functions import ordered
from fluxprint.functions.scalars import canonical_ip, certificate_names, is_endpoint_domain, null_if_unset, valid_ip

FOREVER = 2**53


def covers(start: Column, end: Column, t: Column) -> Column:
    """Start inclusive, end exclusive, a missing end is open."""
    return (start <= t) & (end.isNull() | (t < end))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (b_end.isNull() | (a_start < b_end)) & (a_end.isNull() | (b_start < a_end))


def merged_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Spans of each key joined where they touch, as ``keys, _s, _e``."""
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    rows = spans.select(*keys, F.coalesce(F.col(start).cast("double"), F.lit(float(-FOREVER))).alias("_s"),
                        F.coalesce(F.col(end).cast("double"), F.lit(float(FOREVER))).alias("_e"))
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("_s") > reach, F.lit(True)).cast("int")
    numbered = rows.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_island")


def contested(spans: DataFrame, resource: Sequence[str], owner: str, start: str, end: str) -> DataFrame:
    """Stretches of time in which a resource has several owners at once.

    Each owner's spans are merged first. A running count of opened and closed
    spans then exceeds one exactly while two owners overlap, so spans are sorted
    once and never paired.
    """
    whole = merged_spans(spans, [*resource, owner], start, end)
    steps = whole.select(*resource, F.explode(F.array(
        F.struct(F.col("_s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("_e").alias("at"), F.lit(-1).alias("d"))
    )).alias("_x")).select(*resource, "_x.at", "_x.d")
    w = Window.partitionBy(*resource).orderBy("at", "d")
    live = steps.select(*resource, F.col("at").alias("_s"), F.lead("at").over(w).alias("_e"),
                        F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("owners"))
    return live.filter((F.col("owners") > 1) & (F.col("_e") > F.col("_s")))


def ownership_segments(leases: DataFrame, key: str = "ip") -> DataFrame:
    """The time of each address cut into disjoint stretches with one owner, or with several.

    Owners enter and leave at the ends of their merged leases; a running count tells how many there
    are and a running XOR of their hashes who a single one is. So an instant lies in one stretch at
    most; ``owners`` over one makes a lookup there fail.
    """
    whole = merged_spans(leases.select(key, "device", "lease_start", "lease_end"), [key, "device"], "lease_start", "lease_end").withColumn("_h", F.xxhash64("device"))
    steps = whole.select(key, "_h", F.explode(F.array(
        F.struct(F.col("_s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("_e").alias("at"), F.lit(-1).alias("d")))).alias("_x"))
    turns = steps.groupBy(key, F.col("_x.at").alias("segment_start")).agg(F.sum("_x.d").alias("_d"), F.bit_xor("_h").alias("_x"))
    order = Window.partitionBy(key).orderBy("segment_start")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    live = turns.select(key, "segment_start", F.lead("segment_start").over(order).alias("segment_end"),
                        F.sum("_d").over(upto).cast("int").alias("owners"), F.bit_xor("_x").over(upto).alias("_h")).filter("owners > 0")
    named = live.join(ordered.growing(whole.select(key, "_h", F.col("device").alias("owner")).distinct()), [key, "_h"], "left")
    return named.select(key, "segment_start", "segment_end", F.when(F.col("owners") > 1, "contested").otherwise(F.col("owner")).alias("owner"), "owners")


def at_instant(asked: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, start: str, end: str, fields: Sequence[str], slice_seconds: float = 86_400.0) -> DataFrame:
    """Distinct ``(keys, t)`` of ``asked`` with the fields of the span that holds ``t``; those in no span are absent.

    Spans of one key are disjoint, so the one begun last by ``t`` is the only one that can hold it.
    """
    marks = spans.select(*keys, F.col(start).alias(t), F.struct(F.col(start).cast("double").alias("_from"), F.col(end).cast("double").alias("_until"), *fields).alias("_span"))
    points = asked.select(*keys, t).distinct()
    found = ordered.running_lookup(points, marks.filter(F.col(t).isNotNull()), keys, t, "_span", slice_seconds)
    inside = F.col("found").isNotNull() & (F.col("found._until").isNull() | (F.col(t) < F.col("found._until")))
    return found.filter(inside).select(*keys, t, *[F.col(f"found.{f}").alias(f) for f in fields])


def _by_mac(found: DataFrame, mac_only: DataFrame, ip: str, mac: str, ts: str, by_ip: Column, out: str) -> DataFrame:
    """``out`` from the address, or without an owner of that from the MAC.

    Rows that have an owner or no MAC ask for none and are dealt out by address and instant, so they don't meet in one task.
    """
    macs = mac_only.filter(F.col("mac").isNotNull()).groupBy(F.lower("mac").alias("_mac")).agg(
        F.min("device").alias("_mac_owner"), F.count_distinct("device").alias("_mac_owners"))
    asks = F.when(F.col("_owner").isNull(), F.lower(F.col(mac)))
    dealt = F.when(asks.isNull(), F.xxhash64(ip, ts)).otherwise(F.lit(0).cast("bigint"))
    known = macs.withColumn("_dealt", F.lit(0).cast("bigint"))
    if not found.isStreaming:       # a micro-batch is small, and would sort anew each time
        known = ordered.growing(known)
    both = found.join(known, (asks == F.col("_mac")) & (dealt == F.col("_dealt")), "left")
    by_mac = F.when(F.col("_mac_owners") > 1, F.raise_error(F.concat(F.lit("ambiguous owner of "), F.col(mac)))
                    .cast("string")).otherwise(F.col("_mac_owner"))
    return both.withColumn(out, F.when(F.col("_owner").isNotNull(), by_ip).otherwise(by_mac)).drop("_mac", "_mac_owner", "_mac_owners", "_dealt")


# C1
def resolve(rows: DataFrame, segments: DataFrame, mac_only: DataFrame | None, ip: str, mac: str | None, ts: str,
            out: str) -> DataFrame:
    """Device behind an address at a time; the MAC counts only without a lease.

    ``mac_only`` holds devices that have no lease at all. More than one owner at
    the time of an observed row is an error, as no answer would be right. This form joins by
    range, which a stream can; :func:`resolve_flow` looks distinct instants up instead.
    """
    seg = segments.select(F.col("ip").alias("_ip"), "segment_start", "segment_end", F.col("owner").alias("_owner"),
                          F.col("owners").alias("_owners"))
    t = F.col(ts)
    found = rows.join(seg, (F.col(ip) == F.col("_ip")) & (F.col("segment_start") <= t) & (t < F.col("segment_end")),
                      "left")
    by_ip = F.when(F.col("_owners") > 1, F.raise_error(F.concat(F.lit("ambiguous owner of "), F.col(ip)))
                   .cast("string")).otherwise(F.col("_owner"))
    dropped = ["_ip", "segment_start", "segment_end", "_owner", "_owners"]
    if mac_only is None or mac is None:
        return found.withColumn(out, by_ip).drop(*dropped)
    return _by_mac(found, mac_only, ip, mac, ts, by_ip, out).drop(*dropped)


def both_ends(telemetry: DataFrame, ts: str) -> DataFrame:
    """The address of either end with the row's instant, as ``ip, ts``."""
    return telemetry.select(F.explode(F.array("orig_h", "resp_h")).alias("ip"), ts)


def owners_over_time(leases: DataFrame, devices: DataFrame, grows: bool = True) -> tuple[DataFrame, DataFrame]:
    """The owners of each address, by stretch of time, and the MACs of devices without a lease."""
    leased = leases.select("device").distinct()
    mac_only = devices.join(ordered.growing(leased) if grows else leased, "device", "left_anti").select("device", "mac")
    return ownership_segments(leases), mac_only


def resolve_flow(telemetry: DataFrame, leases: DataFrame, devices: DataFrame, ts: str = "window_start",
                 known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Adds ``orig_device`` and ``resp_device``.

    ``known`` are the :func:`owners_over_time` if they are stored; a stream would make them anew in each micro-batch. Each distinct address and instant of either end is looked up once, by order of time, so an
    address with any number of leases meets one of them; rows then meet their answer by equality.
    """
    segments, mac_only = owners_over_time(leases, devices, not telemetry.isStreaming) if known is None else known
    if not telemetry.isStreaming:
        owners = at_instant(both_ends(telemetry, ts), segments, ["ip"], ts, "segment_start", "segment_end", ["owner", "owners"])
        rows = telemetry
        for side in ("orig", "resp"):
            ip, out = f"{side}_h", f"{side}_device"
            known = owners.select(F.col("ip").alias(ip), ts, F.col("owner").alias("_owner"), F.col("owners").alias("_owners"))
            by_ip = F.when(F.col("_owners") > 1, F.raise_error(F.concat(F.lit("ambiguous owner of "), F.col(ip))).cast("string")).otherwise(F.col("_owner"))
            rows = _by_mac(rows.join(ordered.growing(known), [ip, ts], "left"), mac_only, ip, f"{side}_mac", ts, by_ip, out).drop("_owner", "_owners")
        return rows.select(*telemetry.columns, "orig_device", "resp_device")
    first = resolve(telemetry, segments, mac_only, "orig_h", "orig_mac", ts, "orig_device")
    return resolve(first, segments, mac_only, "resp_h", "resp_mac", ts, "resp_device")


# C2
def as_of_binding(rows: DataFrame, bindings: DataFrame, on: Sequence[str], ts: str, fields: Sequence[str]) -> DataFrame:
    """Left join to the binding of the key that is valid at ``ts``.

    Bindings of one key must not overlap (see the validation of bindings), so
    a row keeps its single match. Distinct keys and instants are looked up by order of time.
    """
    side = bindings.select(*on, "valid_from", "valid_until", *[F.col(f).alias("bound_" + f) for f in fields])
    bound = at_instant(rows, side, on, ts, "valid_from", "valid_until", ["bound_" + f for f in fields])
    return rows.join(ordered.growing(bound), [*on, ts], "left").select(*rows.columns, *["bound_" + f for f in fields])


# C3
def clipped_inventory(grid: DataFrame, leases: DataFrame, window: int) -> DataFrame:
    """Leases clipped to each window, and the devices that a window cannot score.

    A device is out when a lease begins or ends strictly inside the window, or
    when no lease of it is live. ``grid`` holds ``device, window_start``, windows at multiples of
    ``window``. A lease is cut at the windows of the grid's time, which are its result rows, so that
    no window meets a lease that it does not touch.
    """
    start = F.col("window_start")
    end = start + window
    step = F.lit(window).cast("bigint")
    reach = grid.agg(F.struct(F.min("window_start").alias("lo"), F.max("window_start").alias("hi")).alias("r"))
    spans = leases.select(F.col("device").alias("_d"), "ip", "lease_start", "lease_end").withColumn("_r", reach.scalar())
    lo = F.greatest((F.floor(F.col("lease_start") / window) * window).cast("bigint"), F.col("_r.lo"))
    hi = F.least(((F.ceil(F.col("lease_end") / window) - 1) * window).cast("bigint"), F.col("_r.hi"))   # least and greatest pass over an open end
    cut = spans.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi").withColumn("_w", F.explode(F.sequence("_lo", "_hi", step)))
    live = grid.join(ordered.unfolded(cut.drop("_r", "_lo", "_hi")), (F.col("device") == F.col("_d")) & (F.col("_w") == start), "left")
    moved = ((F.col("lease_start") > start) & (F.col("lease_start") < end)) | (
        (F.col("lease_end") > start) & (F.col("lease_end") < end))
    return live.select(
        "device", "window_start", "ip",
        F.when(F.col("_d").isNotNull(), F.greatest("lease_start", start)).alias("clip_start"),
        F.when(F.col("_d").isNotNull(), F.least(F.coalesce("lease_end", end), end)).alias("clip_end"),
        F.coalesce(moved, F.lit(False)).alias("_moved"), F.col("_d").isNull().alias("_none"))


def inventory_status(clipped: DataFrame) -> DataFrame:
    return clipped.groupBy("device", "window_start").agg(
        F.count("ip").alias("live_leases"), F.min("clip_start").alias("first_clip"), F.max("clip_end").alias("last_clip"),
        F.bool_or(F.col("_moved") | F.col("_none")).alias("unavailable"))


# G1
def identity_marks(spans: DataFrame, window: int) -> DataFrame:
    """Where the set of things that make up a device's identity changes, as ``device, window_start, mark``.

    ``spans`` holds ``device, value, start, end``: an address, a hardware address or a kind, and
    when it held (a missing end is open). A value counts in every window that its span touches.
    The running XOR of the marks of a device is a digest of the set that holds in a window: a
    value's hash enters with its first window and leaves after its last, so a device costs two
    rows per span and no window meets all spans.
    """
    whole = merged_spans(spans, ["device", "value"], "start", "end")
    first = F.floor(F.col("_s") / window) * window
    after = F.when(F.col("_e") < FOREVER, F.ceil(F.col("_e") / window) * window)
    ends = F.explode(F.filter(F.array(first.cast("bigint"), after.cast("bigint")), lambda x: x.isNotNull()))
    marks = whole.select("device", F.xxhash64("value").alias("mark"), ends.alias("window_start"))
    return marks.groupBy("device", "window_start").agg(F.bit_xor("mark").alias("mark"))


# C4
def addresses_of(connections: DataFrame) -> DataFrame:
    """Distinct ``(device, ip)`` a device opened flows from."""
    return connections.select("device", null_if_unset(F.col("orig_h")).alias("ip")).filter("ip is not null").distinct()


def rows_of_addresses(log: DataFrame, owned: DataFrame, ip: str = "orig_h") -> DataFrame:
    """Give the rows of a log without MACs to the devices that own their address."""
    return log.join(owned.select("device", F.col("ip").alias(ip)), ip)


def dns_stream(dns_log: DataFrame, owned: DataFrame) -> DataFrame:
    """Lower-cased endpoint queries per device; local and reverse names go."""
    q = F.lower(null_if_unset(F.col("query")))
    return (rows_of_addresses(dns_log, owned).select("device", "ts", q.alias("query"))
            .filter(F.col("ts").isNotNull() & F.col("query").isNotNull() & is_endpoint_domain(F.col("query"))))


# C5, B6
def tls_names(ssl_log: DataFrame, x509_log: DataFrame, owned: DataFrame) -> DataFrame:
    """Server names of a device's TLS flows, and of the certificates they used."""
    mine = rows_of_addresses(ssl_log, owned)
    sni = mine.select("device", F.lower(null_if_unset(F.col("server_name"))).alias("name")).filter("name is not null")
    ids = [F.split(null_if_unset(F.col(c)), ",") for c in ("cert_chain_fuids", "client_cert_chain_fuids")
           if c in ssl_log.columns]
    chained = mine.select("device", F.explode(F.concat(*[F.coalesce(i, F.array().cast("array<string>")) for i in ids]))
                          .alias("id")).distinct()
    certs = x509_log.select("id", F.explode(certificate_names(F.col("`certificate.subject`"))).alias("name"))
    return sni.unionByName(chained.join(certs, "id").select("device", "name"))


# C8
def name_evidence(dns_answers: DataFrame, window_start: Column, window_end: Column) -> DataFrame:
    """Addresses that a name answered with, in one spelling each, and until when the answer holds.

    ``dns_answers`` has ``sensor_id, ts, query, answers, ttls`` with lifetimes by
    position; the smallest positive lifetime of a row's addresses counts, and what
    expired before the window is dropped. Answers that are no addresses are passed over.
    One row per answer address; all is decided within the row.
    """
    pairs = F.filter(F.arrays_zip(F.col("answers").alias("address"), F.col("ttls").alias("ttl")), lambda a: valid_ip(a["address"]))
    ttl = F.array_min(F.filter(F.transform(F.col("_pairs"), lambda a: a["ttl"]), lambda t: t > 0))
    rows = dns_answers.filter((F.col("ts") >= 0) & (F.col("ts") < window_end)).withColumn("_pairs", pairs).withColumn("_ttl", ttl)
    until = F.col("ts") + F.col("_ttl")
    addresses = F.array_distinct(F.transform("_pairs", lambda a: canonical_ip(a["address"])))
    return rows.filter(F.col("_ttl").isNotNull() & (until > window_start)).select(
        "sensor_id", F.col("query").alias("name"), F.explode(addresses).alias("address"), F.col("ts").alias("valid_from"), until.alias("valid_until")).distinct()
