"""Tables that are larger than their bytes tell are not sent through the driver; keys that are missing don't meet in one task."""

import pytest
from pyspark.sql import functions as F

from fluxprint.operators import device_features as D
from fluxprint.operators import evidence, graph, identity, policy, residuals
from fluxprint.schemas import Clock

CLOCK = Clock(window=60)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def minutes(spark, tmp_path_factory):
    """View and grid as stored tables, which are small enough to be broadcast."""
    root = tmp_path_factory.mktemp("minutes")
    view = [(60 * w, f"u{w}{d}", "tcp", 443, 60.0 * w + d, True, 1.0, True, False, f"d{d}", out, None, f"10.0.0.{d}", 1, 1, 1, 1, False)
            for w in range(5) for d in range(4) for out in (True, False)]
    schema = ("window_start long, uid string, proto string, port int, flow_start double, new_flow boolean, duration double, established boolean, failed boolean, "
              "device string, originated boolean, peer_device string, peer_address string, tx_bytes long, rx_bytes long, tx_pkts long, rx_pkts long, local boolean")
    grid = [(f"d{d}", "hub", 60 * w, True, 0, 0) for w in range(5) for d in range(4)]
    for name, rows, kind in (("view", view, schema), ("grid", grid, "device string, device_type string, window_start long, available boolean, epoch long, lifetime long")):
        spark.createDataFrame(rows, kind).write.parquet(str(root / name))
    return D.Minutes(spark.read.parquet(str(root / "view")), spark.read.parquet(str(root / "grid")), CLOCK)


FEATURES = {
    "starts": D.starts, "destinations": D.destinations, "volume": lambda m: D.on_grid(m, D.volume(m)), "gaps": D.gap_features, "rolling": D.rolling_gap_variation,
    "streams": D.stream_features, "receiver": lambda m: D.receiver(m, D.on_grid(m, D.volume(m))), "inbound": lambda m: D.inbound_concentration(m, D.peer_services(m))}


@pytest.mark.parametrize("name", FEATURES)
def test_grid_is_not_broadcast(minutes, name):
    df = FEATURES[name](minutes)
    assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)
    assert df.count() > 0


def test_ends_of_edges_and_neighbours_are_not_broadcast(spark, minutes):
    schema = ("window_start long, uid string, orig_device string, resp_device string, proto string, resp_p int, orig_ip_bytes long, "
              "resp_ip_bytes long, orig_pkts long, resp_pkts long, established boolean")
    flows = spark.createDataFrame([(60 * w, f"u{w}", "d0", "d1", "tcp", 443, 10, 5, 1, 1, True) for w in range(5)], schema)
    edges = graph.edges(flows, minutes.grid)
    nodes = minutes.grid.select("device", "window_start", F.lit(1).alias("active_flows"))
    both = graph.neighbour_messages(edges, nodes, ["active_flows"], ["ip_bytes"])
    assert "BroadcastHashJoin" not in plan(edges) and "BroadcastHashJoin" not in plan(both)
    assert edges.count() == 5 and both.count() == 10


def test_cut_leases_are_not_broadcast(spark, minutes):
    leases = spark.createDataFrame([(f"d{d}", f"10.0.0.{d}", 30, None) for d in range(4)], "device string, ip string, lease_start long, lease_end long")
    got = identity.clipped_inventory(minutes.grid.select("device", "window_start"), leases, 60)
    assert "BroadcastHashJoin" not in plan(got) and got.count() == 20


EVENT = "kind string, recorded_at double, trace_id string, decision_id string, request_decision_id string, window_end double, first_flow double, flows long, flagged long, denied long, proposals long, installed_at double"


def event(kind, at, trace=None, decision=None, request=None, value=1):
    return (kind, at, trace, decision, request, float(value), 0.0, value, value, value, value, float(value))


def test_only_events_that_ask_are_joined(spark):
    data = [event("decision", 1.0, "t1", "x1"), event("decision", 2.0, "t2", "x1"), event("decision", 3.0, "t3"), event("window", 4.0, "t1", request="x1"), event("note", 5.0, request="x1"),
            event("note", 6.0, request="x9"), event("note", 7.0), event("window", None, "t4")]
    linked = evidence.link_traces(spark.createDataFrame(data, EVENT))
    assert sorted((r["recorded_at"] or 0.0, r["trace_id"]) for r in linked.collect()) == [
        (0.0, "t4"), (1.0, "t1"), (2.0, "t2"), (3.0, "t3"), (4.0, "t1"), (5.0, "t2"), (6.0, "unlinked"), (7.0, "unlinked")]
    assert "isnull(trace_id" in plan(linked) and "isnotnull(request_decision_id" in plan(linked)


def test_events_are_dealt_out_before_they_are_sorted(spark):
    data = [event("window", 1.0, "t1", value=3), event("window", 2.0, "t1", value=1), event("window", 2.0, "t1", value=2), event("note", 1.0, "unlinked")]
    traces = evidence.assemble_traces(spark.createDataFrame(data, EVENT))
    assert [(r["trace_id"], r["events"], r["flows"]) for r in traces.collect()] == [("t1", 3, 2)]
    assert "REPARTITION_BY_COL" in plan(traces)
    many = spark.createDataFrame([event("window", float(k), "unlinked") for k in range(200)], EVENT)
    assert [(r["events"], r["flows"]) for r in evidence.assemble_traces(many).collect()] == [(200, 1)]


def test_facts_are_dealt_out_before_they_are_folded(spark):
    text = '{"ietf-access-control-list:access-lists":{"acl":[{"aces":{"ace":[{"matches":{"eth":{"controller":"urn:x"}}},{"matches":{"eth":{"controller":"urn:y"}}}]}}]}}'
    facts = policy.document_facts(spark.createDataFrame([(1, text), (2, text)], "document_id long, text string"))
    assert sorted(tuple(r) for r in facts.collect()) == [(1, "permission", "controller", 2), (2, "permission", "controller", 2)]
    assert "REPARTITION_BY_COL" in plan(facts)


def final_plan(df):
    """The plan that was run, with what the engine chose anew on the way."""
    df.collect()
    text = plan(df)
    assert "isFinalPlan=true" in text
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def network(spark):
    """Telemetry and a grid of four devices, of which one is known by its MAC alone, one gets another and one is dark for a window."""
    devices = spark.createDataFrame([(f"d{d}", "hub", f"aa:{d}") for d in range(4)], "device string, device_type string, mac string")
    leases = spark.createDataFrame([(f"d{d}", f"10.0.0.{d}", 0, 300) for d in range(3)], "device string, ip string, lease_start long, lease_end long")
    dark = spark.createDataFrame([("d1", 60, 120)], "device string, start long, end long")
    spans = spark.createDataFrame([("d2", "mac:1", 0.0, 100.0), ("d2", "mac:2", 100.0, None)], "device string, value string, start double, end double")
    rows = [(60 * w, f"u{w}{d}", f"10.0.0.{d}", f"10.0.0.{(d + 1) % 4}", f"AA:{d}" if d == 3 else None, None, "tcp", 443, 60.0 * w + d, True, 1.0, True, False, 10, 5, 1, 1)
            for w in range(5) for d in range(4)]
    schema = ("window_start long, uid string, orig_h string, resp_h string, orig_mac string, resp_mac string, proto string, resp_p int, flow_start double, new_flow boolean, "
              "observed_duration double, established boolean, failed boolean, orig_ip_bytes long, resp_ip_bytes long, orig_pkts long, resp_pkts long")
    flows = identity.resolve_flow(spark.createDataFrame(rows, schema), leases, devices)
    return flows, D.Minutes(D.endpoint_view(flows), D.dense_grid(devices, 0, 300, dark, CLOCK, spans), CLOCK)


def excess(flows, m):
    cells = D.on_grid(m, D.volume(m))
    return D.external_excess(cells, D.external_baseline(cells))


def scores(flows, m):
    edges = graph.edges(flows, m.grid).select("window_start", F.col("source").alias("device"), F.log1p("ip_bytes").alias("score"))
    return residuals.source_scores(edges, m.grid.select("device", "window_start"), ["device", "window_start"])


DEVICE_STEPS = {
    "resolved": (lambda flows, m: flows, 20), "grid": (lambda flows, m: m.grid, 20), "degrees": (lambda flows, m: graph.local_degrees(graph.edges(flows, m.grid)), 18),
    "excess": (excess, 19), "scores": (scores, 20), "concentration": (lambda flows, m: D.inbound_concentration(m, D.peer_services(m)), 8)}


@pytest.mark.parametrize("name", DEVICE_STEPS)
def test_what_grows_with_the_devices_stays_off_the_driver(network, name):
    make, n = DEVICE_STEPS[name]
    df = make(*network)
    assert "Broadcast" not in final_plan(df)
    assert df.count() == n


def test_rows_that_ask_for_no_mac_are_dealt_out(network):
    flows, m = network
    assert {(r["orig_h"], r["orig_device"]) for r in flows.collect()} == {(f"10.0.0.{d}", f"d{d}") for d in range(4)}
    assert {r["resp_device"] for r in flows.filter("resp_h = '10.0.0.3'").collect()} == {None}
    joins = [line for line in plan(flows).splitlines() if "SortMergeJoin" in line and "lower(orig_mac" in line]
    assert joins and all("xxhash64(orig_h" in line for line in joins)
