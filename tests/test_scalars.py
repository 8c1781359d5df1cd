from pyspark.sql import functions as F

from fluxprint.functions import scalars as S


def values(spark, kind, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"value {kind}").select(column(F.col("value"))).collect()]


def test_names(spark):
    assert values(spark, "string", ["a.b.local", "1.in-addr.arpa", "api.example.com"], S.is_endpoint_domain) == [False, False, True]
    assert values(spark, "string", ["a b.com", "nodot", "x.c", "x.co", "x.co1", "münchen.köln"], S.looks_like_hostname) == [
        False, False, False, True, False, True]
    assert values(spark, "string", ["Plug_50c7bf005639", "Plug_50C7BF005639.pcap", "Plug", "Plug_50c7bf00563"], S.mac_from_name) == [
        "50:c7:bf:00:56:39", "50:c7:bf:00:56:39", None, None]
    assert values(spark, "string", ["CN=*.Api.Example.com, O=x", "O=x,CN=class 3 ca - g4", "CN=ok.example.org"], S.certificate_names) == [
        ["api.example.com"], [], ["ok.example.org"]]
    assert values(spark, "string", ["AmazonEcho_44", "SmartDoorLock_x", None, "HPPrinter_1"], S.display_name) == [
        "Amazon Echo", "Smart Door Lock", "Unknown device", "HP Printer"]
    assert values(spark, "string", ["cam_2016-09-23.csv", "cam-DAY3.csv", "cam_part2", "cam.a_7.csv"], S.device_from_file) == ["cam", "cam", "cam", "cam.a"]


def test_services(spark):
    rows = spark.createDataFrame([("udp", 443), ("udp", 9), (None, None), ("icmp", 8), ("tcp", 53)], "p string, q int")
    got = rows.select(S.service_category(F.col("p"), F.col("q")), S.port_key(F.col("p"), F.col("q"))).collect()
    assert [tuple(r) for r in got] == [("tls", "udp/443"), ("other_udp", "udp/9"), ("other_tcp", None), ("other_tcp", "icmp/8"), ("dns", "tcp/53")]


def test_addresses(spark):
    assert values(spark, "string", ["10.0.0.1", "256.1.1.1", "x", "0.0.1.0", None], S.ipv4_number) == [167772161, None, None, 256, None]
    assert values(spark, "string", ["10.1.1.1", "8.8.8.8", "192.168.0.1", "bad", "172.32.0.1"], S.is_private_ipv4) == [True, False, True, False, False]
    assert values(spark, "string", ["fe80::1", "2606:4700::1", "bad"], S.is_private_ipv6) == [True, False, False]
    pairs = spark.createDataFrame([("fd00::1", "fd00::/8"), ("::1", "fd00::/8"), ("x", "y")], "a string, n string")
    assert [r[0] for r in pairs.select(S.ipv6_in_network(F.col("a"), F.col("n"))).collect()] == [True, False, False]
    nets = spark.createDataFrame([("10.1.2.3/16",), ("10.0.0.0/40",), ("10.0.0.1",), ("junk/8",)], "n string")
    assert [tuple(r) for r in nets.select(*S.network_parts(F.col("n"))).collect()] == [(167837696, 16), (None, None), (167772161, 32), (None, None)]


def test_numbers(spark):
    assert values(spark, "double", [-5.0, 0.5, 9.0, None], lambda c: S.clip(c, 0.0, 1.0)) == [0.0, 0.5, 1.0, None]
    assert values(spark, "long", [0, 3599, 86_400 + 7200, -1], S.utc_hour) == [0, 0, 2, 23]
    assert values(spark, "double", [1e16, 1e13, 1e11, 1e9], S.epoch_unit_factor) == [1e-9, 1e-6, 1e-3, 1.0]


def test_digest_is_stable_and_sees_nulls(spark):
    rows = spark.createDataFrame([("x", None), ("x", "y")], "b string, a string")
    one, two = [r[0] for r in rows.select(S.digest("b", "a")).collect()]
    assert one != two and one == rows.select(S.digest("a", "b")).first()[0]


def test_ipv6_in_any_spelling(spark):
    import ipaddress

    texts = ["2001:DB8::1", "2001:db8:0:0:0:0:0:1", "::", "::1", "1::", "fe80::1:0:0:2", "::ffff:10.0.0.1", "1:2:3:4:5:6:7:8", "0:0:1:0:0:0:1:0", "2001:3::5",
             "64:ff9b::1", "::ffff:8.8.8.8", "1:0:0:2:0:0:0:3", "ff02::fb",
             "1:2:3", "fffff::1", "1::2::3", ":1", "1:", ":::", "1:2:3:4:5:6:7:8:9", "999.1.1.1", "a:b", "", "::1.2.3", "1.2.3.4:5", "::g", None, "10.0.0.1"]

    def parsed(t):
        try:
            return ipaddress.ip_address(t)
        except ValueError:
            return None

    known = [parsed(t) for t in texts]
    assert values(spark, "string", texts, S.valid_ip) == [k is not None for k in known]
    plain = [None if k is None else str(k) for k in known]
    plain[6] = plain[11] = None        # the library prints mapped addresses in two ways
    got = values(spark, "string", texts, S.canonical_ip)
    assert (got[6], got[11]) == ("::ffff:a00:1", "::ffff:808:808")
    assert [None if i in (6, 11) else g for i, g in enumerate(got)] == plain
    assert values(spark, "string", texts, S.is_private_ipv6) == [isinstance(k, ipaddress.IPv6Address) and k.is_private for k in known]
    nets = ["2001:db8::/32", "::/0", "fe80::/10", "::1", "2001:db8::/31", "bad/3", "::/129"]
    pairs = [(t, n) for t in texts for n in nets]
    rows = spark.createDataFrame(pairs, "a string, n string").select(S.ipv6_in_network(F.col("a"), F.col("n"))).collect()

    def inside(t, n):
        try:
            return ipaddress.IPv6Address(t) in ipaddress.IPv6Network(n)
        except ValueError:
            return False

    assert [r[0] for r in rows] == [inside(t, n) for t, n in pairs]
