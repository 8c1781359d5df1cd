"""What the device queries share is stored once, so no plan holds it several times over and the driver keeps track of few exchanges."""

import datetime
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxprint.operators import device_features as D
from fluxprint.plans import ORACLES, QUERIES, devices
from fluxprint.schemas import Clock

START = datetime.datetime(2024, 1, 1)
KINDS = ["click", "view", "purchase", "error", "signup"]
MOST = 24       # exchanges; with the shared steps in each plan it was over 50


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Events of 40 users over 30 days; one in two asks another user's address."""
    rows = [(i, START + datetime.timedelta(seconds=4_300 * i + i % 7), i * 7 % 40, KINDS[i % 5], 1.0 + i % 50, f'{{"k": {i * 13 % 80}}}') for i in range(600)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


NAMES = [
    "f16_edges",
    "f20_neighbour_messages",
    "f15_peer_degrees",
    "f19_edge_descriptor",
    "f21_undirected",
    "g8_service_context",
    "f14_inbound_concentration",
    "f2_destinations_ports",
    "f6_gap_features",
    "f4_new_destinations",
    "g4_first_seen",
]


@pytest.mark.parametrize("name", NAMES)
def test_plan_is_small_and_agrees_with_sql(spark, tables, name):
    from check_oracle import difference

    df = QUERIES[name](spark, tables)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= MOST
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
    assert difference(df, con, ORACLES[name]) is None


def test_each_table_of_features_may_be_stored(spark):
    view = spark.createDataFrame([], "window_start long, uid string, proto string, port int, flow_start double, new_flow boolean, duration double, established boolean, "
                                     "failed boolean, device string, originated boolean, peer_device string, peer_address string, tx_bytes long, rx_bytes long, "
                                     "tx_pkts long, rx_pkts long, local boolean")
    inventory = spark.createDataFrame([("a", "hub")], "device string, device_type string")
    m = D.Minutes(view, D.dense_grid(inventory, 0, 120, spark.createDataFrame([], "device string, start long, end long"), Clock(window=60)), Clock(window=60))
    edges = spark.createDataFrame([], "window_start long, source string, target string")
    kept = []
    table = D.feature_table(m, D.flow_profile(D.peer_services(m)), spark.createDataFrame([], "device string, baseline double"), edges,
                            lambda df, name: (kept.append(name), df)[1])
    assert kept.count("cells") == 1 and kept.count("features") == 14 and table.count() == 2


def test_shuffles_of_a_stored_table_are_let_go(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    devices.release(spark)
    time.sleep(2)
    before = held.size()
    stored = devices.alone(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "sevenths")
    until = time.time() + 20
    while held.size() > before and time.time() < until:
        time.sleep(0.2)
    assert held.size() <= before
    assert sorted(r.n for r in stored.collect()) == [142, 143, 143, 143, 143, 143, 143]
