"""Column contracts: record layouts, feature names and fixed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The text that flow logs write for "not set".
UNSET = ["-", "(empty)", ""]

# Connection states of a TCP handshake that never completed.
FAILED_STATES = ["S0", "REJ", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR"]

# Service category per well-known port; other ports fall back
# to the transport.
SERVICE_PORTS = {
    "dns": [53],
    "web": [80, 8080, 9090],
    "tls": [443, 8443],
    "ntp": [123],
    "discovery": [1900, 5353],
    "messaging": [1883, 8883, 5683],
}
SERVICES = ["dns", "web", "tls", "ntp", "discovery", "messaging", "other_tcp", "other_udp"]

# Known kinds of device, and the pseudo kind of a remote service.
DEVICE_TYPES = ["hub", "speaker", "light", "plug", "camera", "doorbell", "motion_sensor", "printer",
                "environmental_sensor", "scale", "unknown"]
EXTERNAL_TYPE = "external_service"

CONN_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("uid", T.StringType()),
    T.StructField("id.orig_h", T.StringType()),
    T.StructField("id.orig_p", T.IntegerType()),
    T.StructField("id.resp_h", T.StringType()),
    T.StructField("id.resp_p", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("orig_bytes", T.LongType()),
    T.StructField("resp_bytes", T.LongType()),
    T.StructField("conn_state", T.StringType()),
    T.StructField("orig_pkts", T.LongType()),
    T.StructField("orig_ip_bytes", T.LongType()),
    T.StructField("resp_pkts", T.LongType()),
    T.StructField("resp_ip_bytes", T.LongType()),
    T.StructField("orig_l2_addr", T.StringType()),
    T.StructField("resp_l2_addr", T.StringType()),
])

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("window_start", T.LongType()),
    T.StructField("uid", T.StringType()),
    T.StructField("orig_h", T.StringType()),
    T.StructField("resp_h", T.StringType()),
    T.StructField("orig_p", T.IntegerType()),
    T.StructField("resp_p", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("flow_start", T.DoubleType()),
    T.StructField("orig_ip_bytes", T.LongType()),
    T.StructField("resp_ip_bytes", T.LongType()),
    T.StructField("orig_pkts", T.LongType()),
    T.StructField("resp_pkts", T.LongType()),
    T.StructField("observed_duration", T.DoubleType()),
    T.StructField("established", T.BooleanType()),
    T.StructField("failed", T.BooleanType()),
    T.StructField("tcp_syn_observed", T.BooleanType()),
    T.StructField("new_flow", T.BooleanType()),
    T.StructField("orig_mac", T.StringType()),
    T.StructField("resp_mac", T.StringType()),
])

HEALTH_SCHEMA = T.StructType([
    T.StructField("window_start", T.LongType()),
    T.StructField("watermark", T.DoubleType()),
    T.StructField("complete", T.BooleanType()),
    T.StructField("sensor_healthy", T.BooleanType()),
    T.StructField("clock_synchronized", T.BooleanType()),
    T.StructField("capture_drops", T.LongType()),
    T.StructField("unavailable_device_ids", T.ArrayType(T.StringType())),
])

# Columns that must agree before two evidence branches may be joined.
IDENTITY = ["run_id", "session_id", "sensor_id", "inventory_version",
            "window_start", "window_end", "observation_kind"]

# Behaviour-window features with a robust baseline, and those trimmed as log1p.
BASELINE_FEATURES = ["flow_count", "unique_destinations", "unique_domains", "domain_entropy",
                     "bytes_total", "orig_bytes", "resp_bytes", "packets_total",
                     "interflow_gap_variance", "tcp_failed_ratio"]
LINEAR_FEATURES = ["domain_entropy", "tcp_failed_ratio"]

# Order matters: the first of equal components is named as the driver.
COMPONENTS = ["new_destinations", "new_domains", "new_ports", "protocol_drift",
              "failed_conns", "volume", "flow_rate"]


@dataclass(frozen=True)
class Clock:
    """Window length and the horizons that are counted in windows."""

    window: int = 60
    short: int = 5
    long: int = 15
    stream: int = 60
    bursts: int = 6

    @property
    def burst_slot(self) -> float:
        return self.window / self.bursts
