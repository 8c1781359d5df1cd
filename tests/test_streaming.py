import random
from statistics import fmean, pstdev

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fluxprint.operators import device_features as D
from fluxprint.operators import graph
from fluxprint.schemas import Clock
from fluxprint.streaming import features, ledger, processors, telemetry
from fluxprint.streaming.sinks import BatchTables, append, drain, not_ahead, timed

ARRIVALS = "observation string, branch string, payload_hash string, at double"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def view_rows(seed):
    rng = random.Random(seed)
    out = []
    for minute in range(40):
        for n in range(0 if minute % 7 == 3 else rng.randrange(1, 5)):
            t = minute * 60 + rng.uniform(0, 59)
            out.append((minute * 60, f"u{minute}-{n}", "tcp", rng.choice([443, 80]), t, True, 1.0, True, False, rng.choice("ab"), rng.random() < .8,
                        None, f"10.0.0.{rng.randrange(6)}", rng.randrange(1000), rng.randrange(1000), 1, 1, False))
    return out


VIEW = ("window_start long, uid string, proto string, port int, flow_start double, new_flow boolean, duration double, established boolean, failed boolean, "
        "device string, originated boolean, peer_device string, peer_address string, tx_bytes long, rx_bytes long, tx_pkts long, rx_pkts long, local boolean")


SPANS = "device string, value string, start double, end double"


def delivered(spark, folder, parts, schema):
    """A stream over a folder, again after each delivery."""
    for part in parts:
        df = part if not isinstance(part, list) else spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(str(folder))
        yield spark.readStream.schema(df.schema).parquet(str(folder))


def test_features_over_restarts_equal_the_batch(spark, tmp_path):
    clock = Clock(window=60, stream=10, long=6, short=3)
    view = spark.createDataFrame(view_rows(7), VIEW)
    devices = spark.createDataFrame([("a", "hub"), ("b", "plug"), ("c", "silent")], "device string, device_type string")
    dark = spark.createDataFrame([("a", 600, 660), ("b", 1200, 1300)], "device string, start long, end long")
    spans = spark.createDataFrame([("a", "mac:1", 0.0, 930.0), ("a", "mac:2", 930.0, None), ("b", "ip:1", 0.0, 1500.0), ("b", "ip:1", 1400.0, 1800.0)], SPANS)
    inventory = features.inventory_rows(devices, 0, dark, spans)
    counts = D.flow_profile(D.peer_services(D.Minutes(view.filter("window_start < 900"), None, clock)))
    base = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "device string, baseline double")
    sink = features.DeviceFeatures(BatchTables(str(tmp_path / "out")), clock, counts, base)
    cuts = [0, 500, 1300, 1301, 2400]
    for stream in delivered(spark, tmp_path / "in", [view.filter((F.col("flow_start") >= lo) & (F.col("flow_start") < hi)) for lo, hi in zip(cuts, cuts[1:])], VIEW):
        rows_ = timed(stream, F.col("flow_start"), 30)
        drain(features.closed_windows(rows_, inventory, clock), sink.process, str(tmp_path / "checkpoint"))
    got = sink.tables.all(spark, "features")
    end = got.agg(F.max("window_start")).first()[0] + 60
    batch = D.feature_table(D.Minutes(view.filter(F.col("window_start") < end), D.dense_grid(devices, 0, end, dark, clock, spans), clock), counts, base)
    assert end > 2000 and set(got.columns) == set(batch.columns)
    fixed = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(batch.dtypes)]
    assert rows(got, *fixed) == rows(batch, *fixed)
    ends = {(r.device, r.window_start): (r.epoch, r.lifetime) for r in got.collect()}
    # window 900 has both MACs, 960 the new one: two changes; outages end an epoch, not a lifetime
    assert [ends["a", w] for w in (600, 660, 840, 900, 960)] == [(0, 0), (1, 0), (1, 0), (2, 1), (3, 2)]
    assert ends["b", 1740] == (2, 0) and ends["b", 1800] == (3, 1) and ends["c", 1800] == (0, 0)
    late = view.filter("flow_start < 60")
    for stream in delivered(spark, tmp_path / "in", [late], VIEW):
        drain(features.closed_windows(timed(stream, F.col("flow_start"), 30), inventory, clock), sink.process, str(tmp_path / "checkpoint"))
    assert sink.tables.all(spark, "closed").filter("kind = 'late'").count() == late.count()


@pytest.mark.parametrize("what", ["destinations", "initiators", "streams"])
def test_limits_fail_the_batch(spark, tmp_path, what):
    clock, many = Clock(window=60), 6
    out = what != "initiators"
    data = [(0, f"u{i}", "tcp", i if what == "streams" else 443, float(i), True, 1.0, True, False, "a", out, None, "10.0.0.1" if what == "streams" else f"10.0.0.{i}",
             1, 1, 1, 1, False) for i in range(many)] + [(600, "z", "tcp", 443, 600.0, True, 1.0, True, False, "a", True, None, "x", 1, 1, 1, 1, False)]
    inventory = spark.createDataFrame([("a", "device", "hub", 0.0, None)], "device string, kind string, value string, start double, end double")
    for most, fails in ((many, False), (many - 1, True)):
        for stream in delivered(spark, tmp_path / f"in{most}", [data], VIEW):
            closed = features.closed_windows(timed(stream, F.col("flow_start"), 0), inventory, clock, most)
            if fails:
                with pytest.raises(Exception, match=f"more than {most} {what}"):
                    append(closed, str(tmp_path / f"out{most}"))
            else:
                assert append(closed, str(tmp_path / f"out{most}")).filter("kind = 'row'").count() == many


def test_edges_are_new_again_with_another_identity_and_bounded(spark, tmp_path):
    clock = Clock(window=60)
    flow = lambda w, o, r: (w, f"u{w}{o}{r}", o, r, "tcp", 443, float(w), 10, 5, 1, 1, True)
    schema = ("window_start long, uid string, orig_device string, resp_device string, proto string, resp_p int, flow_start double, orig_ip_bytes long, "
              "resp_ip_bytes long, orig_pkts long, resp_pkts long, established boolean")
    data = [flow(w, o, r) for w in (0, 60, 120, 180, 240) for o, r in (("a", "b"), ("a", None), (None, "b"))]
    devices = spark.createDataFrame([("a", "hub"), ("b", "plug")], "device string, device_type string")
    dark = spark.createDataFrame([("b", 60, 120)], "device string, start long, end long")
    spans = spark.createDataFrame([("a", "mac:1", 0.0, 120.0), ("a", "mac:2", 120.0, None)], SPANS)
    grid = D.dense_grid(devices, 0, 300, dark, clock, spans)
    for stream in delivered(spark, tmp_path / "in", [data[:7], data[7:] + [flow(900, "a", "b")]], schema):
        got = append(features.closed_edges(stream, grid, clock, 0.0), str(tmp_path / "out"))
    batch = graph.edges(spark.createDataFrame(data, schema), grid)
    assert rows(got, *batch.columns) == rows(batch, *batch.columns)
    assert {(r.window_start, r.source, r.target) for r in got.filter("new_edge").collect()} == {
        (0, "a", "b"), (0, "a", "external_service:tls"), (0, "external_service:tls", "b"), (120, "a", "b"), (120, "a", "external_service:tls")}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="more than 1 edges"):
        append(features.closed_edges(stream, grid, clock, 0.0, most=1), str(tmp_path / "bounded"))


def test_rows_from_the_future_go_aside(spark):
    df = spark.createDataFrame([(1.0,), (4e9,)], "at double")
    fine, ahead = not_ahead(df, F.col("at"))
    assert [r[0] for r in fine.collect()] == [1.0] and [r[0] for r in ahead.collect()] == [4e9]


def test_deadline_literal(spark, tmp_path):
    data = [("w1", "window", "x", 100.0), ("w1", "gnn", "g", 101.0), ("w1", "mud", "m", 112.0), ("w2", "window", "x", 120.0),
            ("w2", "gnn", "g", 121.0), ("w2", "gnn", "changed", 122.0), ("w2", "gnn", "g", 123.0), ("w2", "mud", "m", 124.0), ("w3", "mud", "m", 125.0)]
    closed, fates = ledger.deadline_join(spark.createDataFrame(data, ARRIVALS), 10.0)
    want = rows(fates, "observation", "branch", "at", "fate")
    assert [w[3] for w in want] == ["accepted", "late", "accepted", "conflict", "duplicate", "accepted", "early"]
    assert {(r["observation"], r["closed_at"], r["partial"]) for r in closed.collect()} == {("w1", 110.0, True), ("w2", 124.0, False)}
    for stream in delivered(spark, tmp_path / "in", [data[i:i + 3] for i in range(0, len(data), 3)] + [[("w9", "window", "x", 140.0)]], ARRIVALS):
        got = append(ledger.deadline_stream(stream, 10.0), str(tmp_path / "out"))
    assert rows(got.filter("branch <> 'window'"), "observation", "branch", "at", "fate") == want
    # w3 has no observation; w9 is still open
    assert rows(got.filter("branch = 'window'"), "observation", "at", "fate") == [("w1", 110.0, "closed_partial"), ("w2", 124.0, "closed_complete")]


def test_silent_observation_closes_by_its_timer(spark, tmp_path):
    """Nothing more arrives for w1; another one moves event time past its deadline."""
    for stream in delivered(spark, tmp_path / "in", [[("w1", "window", "x", 100.0)], [("w2", "window", "x", 111.0)], [("w1", "gnn", "g", 105.0)]], ARRIVALS):
        got = append(ledger.deadline_stream(stream, 10.0), str(tmp_path / "out"))
    assert rows(got, "observation", "branch", "at", "fate") == [("w1", "gnn", 105.0, "late"), ("w1", "window", 110.0, "closed_partial")]


def test_no_answer_depends_on_a_clock(spark, tmp_path):
    """Gaps of 30 days: stream and batch still agree."""
    day = 86_400.0
    data = [("w1", "window", "x", 0.0), ("w1", "gnn", "g", 1.0), ("w2", "window", "x", 30 * day), ("w1", "mud", "m", 30 * day + 1), ("w1", "gnn", "g", 60 * day),
            ("w2", "mud", "m", 60 * day), ("w3", "gnn", "g", 90 * day)]
    want = rows(ledger.deadline_join(spark.createDataFrame(data, ARRIVALS), 10.0)[1], "observation", "branch", "at", "fate")
    for stream in delivered(spark, tmp_path / "in", [data[:2], data[2:4], data[4:]], ARRIVALS):
        got = append(ledger.deadline_stream(stream, 10.0), str(tmp_path / "join"))
    assert rows(got.filter("branch <> 'window'"), "observation", "branch", "at", "fate") == want
    assert [w[3] for w in want if w[0] == "w1"] == ["accepted", "late", "late"]

    schema = "stream string, window_start long, payload_hash string, at double"
    data = [("s", 60, "a", 1.0), ("s", int(30 * day), "b", 30 * day), ("s", 60, "a", 60 * day), ("s", 60, "z", 60 * day + 1)]
    for stream in delivered(spark, tmp_path / "arrivals", [[row] for row in data], schema):
        got = append(ledger.ingest_stream(stream), str(tmp_path / "ingest"))
    assert [r[1] for r in rows(got, "at", "status")] == ["accepted", "accepted", "replay", "conflict"]



def test_one_stream_is_cut_into_slices(spark):
    data = [("s", w, f"h{w}", float(k)) for k, w in enumerate(range(0, 40_000, 2))] + [("s", 30, "x", 50_000.0)]
    got = ledger.classify_ingest(spark.createDataFrame(data, "stream string, window_start long, payload_hash string, at double"))
    assert {r["status"]: r["count"] for r in got.groupBy("status").count().collect()} == {"accepted": 20_000, "conflict": 1}
    assert "hashpartitioning(stream#" in got._jdf.queryExecution().executedPlan().toString() and "_slice" in got._jdf.queryExecution().executedPlan().toString()


def test_ingest_in_batches(spark, tmp_path):
    data = [("s", 60, "a", 1.0), ("s", 120, "b", 2.0), ("s", 60, "a", 3.0), ("s", 60, "z", 4.0), ("s", 0, "q", 5.0), ("s", 180, "c", 6.0)]
    schema = "stream string, window_start long, payload_hash string, at double"
    whole = rows(ledger.classify_ingest(spark.createDataFrame(data, schema)), "at", "status")
    assert [w[1] for w in whole] == ["accepted", "accepted", "replay", "conflict", "out_of_order", "accepted"]
    for stream in delivered(spark, tmp_path / "in", [data[:2], data[2:5], data[5:]], schema):
        got = append(ledger.ingest_stream(stream), str(tmp_path / "out"))
    assert rows(got, "at", "status") == whole


PACKETS = ("ts double, uid string, orig_h string, resp_h string, orig_p int, resp_p int, proto string, flow_start double, from_orig boolean, "
           "ip_bytes long, established boolean, rejected boolean, syn boolean")


def packet(ts, uid, start, out=True, n=10, **signals):
    return (ts, uid, "a", "b", 1, 2, "tcp", start, out, n, *(signals.get(s, False) for s in ("established", "rejected", "syn")))


def test_packets_to_intervals_over_restarts(spark, tmp_path):
    one = [packet(1.0, "c", 1.0, syn=True), packet(2.0, "c", 1.0, False, 5), packet(58.0, "d", 58.0, syn=True), packet(130.0, "x", 130.0)]
    two = [packet(61.0, "late", 61.0), packet(131.0, "c", 1.0, established=True), packet(400.0, "x", 400.0)]
    for stream in delivered(spark, tmp_path / "in", [one, two], PACKETS):
        out = append(telemetry.interval_stream(stream, 60, "5 seconds"), str(tmp_path / "out"))     # a new query each time
        late = append(telemetry.late_packets(stream, 60, 5.0), str(tmp_path / "late"))
    assert rows(late, "window_start", "late") == [(60, 1)]
    got = {(r["uid"], r["window_start"]): r for r in out.collect()}
    assert ("late", 60) not in got
    assert (got["c", 0]["orig_ip_bytes"], got["c", 0]["resp_ip_bytes"], got["c", 0]["failed"], got["c", 0]["new_flow"]) == (10, 5, True, True)
    assert (got["c", 120]["established"], got["c", 120]["failed"], got["c", 120]["tcp_syn_observed"], got["c", 120]["new_flow"]) == (True, False, True, False)
    assert not got["d", 0]["failed"]       # two seconds without an answer are not yet a timeout
    batch = telemetry.interval_telemetry(spark.createDataFrame(one + two, PACKETS).filter("uid <> 'late'"), 60)
    both = [c for c in batch.columns]
    assert rows(batch.filter("window_start < 360"), *both) == rows(out, *both)


def test_silent_and_incomplete_windows(spark):
    runs = spark.createDataFrame([("r", 5.0, None, True)], "run_id string, started_at double, stopped_at double, active boolean")
    health = spark.createDataFrame([("r", 0, 61.0, True), ("r", 120, 150.0, True)], "run_id string, window_start long, watermark double, complete boolean")
    got = {r["window_start"]: r["complete"] for r in telemetry.eligible_windows(runs, health, 60, 260.0).collect()}
    assert got == {0: True, 60: False, 120: False}


SIGNALS = "run_id bigint, kind string, at double, active boolean, window_start bigint, watermark double, complete boolean"


def test_windows_close_by_timers(spark, tmp_path):
    health = lambda w, mark: (1, "health", mark, None, w, mark, True)
    parts = [[(1, "start", 5.0, True, None, None, None), health(0, 61.0)], [(2, "start", 170.0, False, None, None, None)], [health(120, 181.0), (2, "stop", 200.0, None, None, None, None)],
             [(3, "start", 400.0, False, None, None, None), health(60, 300.0)], [(4, "start", 500.0, False, None, None, None)]]
    for stream in delivered(spark, tmp_path / "in", parts, SIGNALS):
        got = append(telemetry.window_stream(stream, 60, 0.0, deadline=30.0, close_delay=5.0), str(tmp_path / "out"))
    of = {(r.window_start, r.fate): (r.complete, r.watermark) for r in got.filter("run_id = 1").collect()}
    # window 60 had no health by its deadline, what came for it at 300 is late; 180 and after stay silent and close all the same
    assert of == {(0, "closed"): (True, 61.0), (60, "closed"): (False, 120.0), (120, "closed"): (True, 181.0), (60, "late"): (True, 300.0)} | {
        (w, "closed"): (False, w + 60.0) for w in range(180, 420, 60)}
    # run 2 has stopped after its first window, of which nothing was heard; run 3 has said nothing yet
    assert rows(got.filter("run_id > 1"), "run_id", "window_start", "complete", "watermark", "fate") == [(2, 120, False, 180.0, "closed")]


def test_a_device_may_have_any_number_of_initiators(spark, tmp_path):
    many, clock = features.MOST_PEERS + 4, Clock(window=60)
    data = [(0, f"u{i}", "tcp", 443, 1.0, True, 1.0, True, False, "a", False, None, f"10.0.{i // 256}.{i % 256}", 1, 1, 1, 1, False) for i in range(many)]
    data.append((600, "z", "tcp", 443, 600.0, True, 1.0, True, False, "a", True, None, "x", 1, 1, 1, 1, False))
    inventory = spark.createDataFrame([("a", "device", "hub", 0.0, None)], "device string, kind string, value string, start double, end double")
    for stream in delivered(spark, tmp_path / "in", [data], VIEW):
        got = append(features.closed_windows(timed(stream, F.col("flow_start"), 0), inventory, clock), str(tmp_path / "out"))
    assert got.filter("kind = 'row'").count() == many


class Held:
    """State in memory that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value


def test_state_is_asked_once_for_what_repeats():
    ingest = processors.IngestProcessor()
    ingest.top, ingest.accepted = Held(), Held()
    arrivals = [Row(window_start=60, payload_hash="a", at=float(k)) for k in range(500)] + [Row(window_start=0, payload_hash="a", at=500.0 + k) for k in range(500)]
    for status in (["accepted"] + ["replay"] * 499 + ["out_of_order"] * 500, ["replay"] * 500 + ["out_of_order"] * 500):
        assert [r["status"] for r in ingest.handleInputRows(("s",), iter(arrivals), None)] == status
    assert ingest.top.calls + ingest.accepted.calls < 12
    signals = processors.SignalProcessor(["window_start", "established_at", "rejected_at", "syn_at"])
    signals.first = Held()
    silent = [Row(window_start=w, established_at=None, rejected_at=None, syn_at=None) for w in (0, 60)]
    assert len(list(signals.handleInputRows(("c",), iter(silent), None))) == 2 and signals.first.calls == 1


class HeldList(Held):
    """A list in memory that counts its calls."""

    def __init__(self):
        super().__init__()
        self.value = []

    def get(self):
        self.calls += 1
        return iter(list(self.value))

    def exists(self):
        self.calls += 1
        return bool(self.value)

    def put(self, rows):
        self.calls += 1
        self.value = list(rows)

    def appendList(self, rows):
        self.calls += 1
        self.value += rows

    def appendValue(self, row):
        self.appendList([row])

    def clear(self):
        self.put([])


class Lists:
    """Gives out counted state, and takes timers."""

    def __init__(self):
        self.states, self.mark = {}, 0

    def getValueState(self, name, *schema):
        return self.states.setdefault(name, Held())

    def getListState(self, name, *schema):
        return self.states.setdefault(name, HeldList())

    def registerTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return self.mark

    def calls(self):
        return sum(s.calls for s in self.states.values())


def test_calls_to_the_state_do_not_grow_with_peers():
    clock, calls, told = Clock(window=60), {}, {}
    names = [c.split()[0] for c in VIEW.split(", ")]
    for peers in (10, 400):
        device, lists = processors.DeviceProcessor(clock, dict(c.split() for c in VIEW.split(", ")), None), Lists()
        device.init(lists)
        device.handleInitialState(("a",), Row(kind="device", value="hub", start=0.0, end=None), None)
        device.handleInitialState(("a",), Row(kind="identity", value="mac:1", start=0.0, end=130.0), None)
        device.handleInitialState(("a",), Row(kind="identity", value="mac:2", start=180.0, end=None), None)
        out = []
        for first in (0, 120, 240):        # the identity changes at 180, between the second and third window of all
            data = [dict.fromkeys(names) | {"window_start": w, "flow_start": w + 1.0, "device": "a", "originated": o, "peer_address": f"p{i}", "proto": "tcp", "port": 443,
                                            "tx_bytes": 1, "new_flow": True, "local": False} for w in (first, first + 60) for o in (True, False) for i in range(peers)]
            assert list(device.handleInputRows(("a",), iter(data), None)) == []
            lists.mark = (first + 120) * 1000
            out += [r for r in device.handleExpiredTimer(("a",), lists, None) if r["kind"] == "cell"]
        calls[peers], told[peers] = lists.calls(), [(r["window_start"], r["lifetime"], r["new_destination_fraction"], r["new_initiator_fraction"]) for r in out]
    assert told[10] == told[400] == [(0, 0, 1.0, 1.0), (60, 0, 0.0, 0.0), (120, 0, 0.0, 0.0), (180, 1, 1.0, 1.0), (240, 1, 0.0, 0.0), (300, 1, 0.0, 0.0)]
    assert calls[10] == calls[400] < 80
    assert len(lists.states["destinations"].value) == 400


def test_a_delivery_costs_few_calls_and_entries(monkeypatch):
    monkeypatch.setattr(processors, "PACK", 30, raising=False)
    device, lists = processors.DeviceProcessor(Clock(window=60), dict(c.split() for c in VIEW.split(", ")), None), Lists()
    device.init(lists)
    facts = [Row(kind="identity", value="mac:1", start=0.0, end=None), Row(kind="device", value="hub", start=0.0, end=None), Row(kind="outage", value=None, start=60.0, end=120.0)]
    device.handleInitialState(("a",), Row(device="a", facts=facts), None)
    names = [c.split()[0] for c in VIEW.split(", ")]
    data = [dict.fromkeys(names) | {"window_start": w, "flow_start": w + 1.0, "device": "a", "originated": i % 2 == 0, "peer_address": f"p{i}", "proto": "tcp", "port": 443,
                                    "tx_bytes": 1, "new_flow": True, "local": False} for w in (0, 60, 120, 180) for i in range(20)]
    began, lists.mark = lists.calls(), 120_000
    assert list(device.handleInputRows(("a",), iter(data), None)) == [] and len(lists.states["held"].value) == 3
    out = list(device.handleExpiredTimer(("a",), lists, None))
    assert [(r["window_start"], r["available"]) for r in out if r["kind"] == "cell"] == [(0, True), (60, False)]
    assert lists.calls() - began <= 13 and len(lists.states["held"].value) == 2
    lists.mark = 240_000
    out = list(device.handleExpiredTimer(("a",), lists, None))
    assert sum(r["kind"] == "row" for r in out) == 40 and lists.states["held"].value == []
    assert [(r["window_start"], r["epoch"], r["new_destination_fraction"]) for r in out if r["kind"] == "cell"] == [(120, 1, 0.0), (180, 1, 0.0)]


def test_variation_of_gaps():
    rng = random.Random(4)
    for n in (2, 5, 40):
        gaps = [rng.uniform(1, 1e5) for _ in range(n)]
        assert processors.variation(gaps, 2) == pytest.approx(pstdev(gaps) / fmean(gaps), rel=1e-12)
    assert processors.variation([0.1] * 7, 4) == 0.0 and processors.variation([0.1] * 3, 4) is None and processors.variation([], 0) is None
    assert processors.variation([3.0, 3.0 + 1e-9], 2) == pytest.approx(pstdev([3.0, 3.0 + 1e-9]) / 3, rel=1e-9)


def test_pairs_are_asked_once_a_batch():
    pairs, lists = processors.PairProcessor(["window_start", "source", "target", "new_edge"], None), Lists()
    pairs.init(lists)
    edge = lambda w, k, life=0: Row(window_start=w, source="a", target=f"t{k}", source_life=life, target_life=0)
    for w, life, new in ((0, 0, True), (60, 0, False), (120, 1, True), (180, 1, False)):
        assert [r["new_edge"] for r in pairs.handleInputRows(("a",), iter([edge(w, k, life) for k in range(200)]), None)] == [new] * 200
    assert lists.calls() <= 6
