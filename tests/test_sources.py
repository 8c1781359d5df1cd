import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxprint.operators.profile import Profile
from fluxprint.sources import files, text_logs


def test_headers_differ_between_and_inside_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("junk before\n#separator x\n#fields\tts\tuid\torig_bytes\n1.5\tA\t-\n2\tB\t7\textra\n#fields\tuid\tts\nC\t9\n")
    (tmp_path / "b.log").write_text("#fields\torig_bytes\tuid\nx\tD\n3\n")
    records = text_logs.read_log(spark, str(tmp_path))
    got = sorted((r["uid"] or "", r["ts"], r["orig_bytes"]) for r in text_logs.connections(records).collect())
    assert got == [("", None, 3), ("A", 1.5, None), ("B", 2.0, 7), ("C", 9.0, None), ("D", None, None)]
    assert text_logs.read_log(spark, str(tmp_path / "missing.log")).count() == 0


def test_device_rows(spark, tmp_path):
    (tmp_path / "c.log").write_text("#fields\tuid\torig_l2_addr\tresp_l2_addr\nA\tm\tx\nB\tx\tm\nC\tx\ty\n")
    records = text_logs.read_log(spark, str(tmp_path / "c.log"))
    assert [r["uid"] for r in text_logs.connections(records, "m").collect()] == ["A"]
    assert {r["uid"] for r in text_logs.connections(records, "m", initiated_only=False).collect()} == {"A", "B"}


def test_headers_and_line_numbers_go_over_splits(spark, tmp_path):
    fields = [["ts", "uid"], ["uid", "ts"]]
    lines, want, number = [], {}, 0
    for part in range(4):
        lines.append("#fields\t" + "\t".join(fields[part % 2]))
        for _ in range(40 if part != 2 else 0):  # the third header is followed by the fourth at once
            number += 1
            row = {"ts": str(number), "uid": f"u{number}"}
            want[row["uid"]] = row["ts"]
            lines.append("\t".join(row[f] for f in fields[part % 2]))
    (tmp_path / "long.log").write_text("\n".join(lines) + "\n")
    bad = {7, 33, 60}
    (tmp_path / "x.jsonl").write_text("".join('{"a": \n' if n in bad else "# note\n" if n % 5 == 0 else '{"a": %d}\n' % n for n in range(1, 61)))
    with_splits = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in with_splits}
    try:
        for k, v in with_splits.items():
            spark.conf.set(k, v)
        read = text_logs.read_lines(spark, str(tmp_path / "long.log"))
        assert read.select("split").distinct().count() > 10
        got = {r["record"]["uid"]: r["record"]["ts"] for r in text_logs.header_records(read).collect()}
        assert got == want
        schema = T.StructType([T.StructField("a", T.LongType())])
        json_read = text_logs.read_lines(spark, str(tmp_path / "x.jsonl"))
        good, wrong = text_logs.json_lines(json_read, schema)
        assert {r["line"] for r in wrong.collect()} == bad
        assert {r["a"] for r in good.collect()} == {n for n in range(1, 61) if n % 5 and n not in bad}
        with pytest.raises(Exception, match=r"invalid JSON in .*x\.jsonl:(7|33|60)"):
            text_logs.strict_json_lines(json_read, schema).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_repeated_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    def batch(times):
        rows = spark.createDataFrame([(t, "decision", f"x{t}", 3) for t in times], "recorded_at double, kind string, decision_id string, size int")
        return files.event_records(rows, ["decision_id", "size"])
    files.append_events(batch([1.0, 2.0, None]), path)
    files.append_events(batch([2.0, None, 3.0, 3.0]), path)
    files.append_events(batch([None]), path)
    assert sorted(str(r["recorded_at"]) for r in spark.read.parquet(path).collect()) == ["1.0", "2.0", "3.0", "None"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n# note\n{"a": \n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    lines = text_logs.read_lines(spark, str(tmp_path / "x.jsonl"))
    good, bad = text_logs.json_lines(lines, schema)
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    with pytest.raises(Exception, match="invalid JSON in"):
        text_logs.strict_json_lines(lines, schema).collect()


def test_records_array_or_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("label", T.IntegerType())])
    (tmp_path / "a.json").write_text(json.dumps([{"label": 1}, {"label": 0}], indent=1))
    (tmp_path / "b.jsonl").write_text('{"label": 1}\n')
    assert files.evaluation_records(spark, str(tmp_path / "a.json"), schema, array=True).count() == 2
    assert files.evaluation_records(spark, str(tmp_path / "b.jsonl"), schema, array=False).count() == 1


def test_documents(spark, tmp_path):
    ace = [{"matches": {"ipv4": {"protocol": 17, "ietf-acldns:dst-dnsname": "Time.Example.com"}, "udp": {"destination-port": {"port": 123}}}},
           {"matches": {"ipv6": {"protocol": 6, "source-ipv6-network": "fd00::/8"}, "l4": {"source-port": {"port": 80}}}},
           {"matches": {"ietf-mud:mud": {"controller": "x"}, "eth": "y"}}]
    (tmp_path / "m.json").write_text(json.dumps({"ietf-access-control-list:access-lists": {"acl": [{"aces": {"ace": ace}}]}}, indent=2))
    got = {(r["kind"], r["fact"]) for r in files.permission_documents(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("domain", "time.example.com"), ("port", "udp/123"), ("network", "fd00::/8"), ("port", "tcp/80"), ("permission", "controller")}


def test_frozen_mark_is_required(spark, tmp_path):
    one = spark.createDataFrame([("d", 1)], "device string, n int")
    files.write_profile(Profile(one, one, one, one, one), str(tmp_path / "p"))
    assert files.read_profile(spark, str(tmp_path / "p"), calibrated=False).observation.count() == 1
    one.write.mode("overwrite").parquet(str(tmp_path / "p" / "observation"))
    with pytest.raises(ValueError):
        files.read_profile(spark, str(tmp_path / "p"), calibrated=False)


def test_snapshots_and_events(spark, tmp_path):
    for v in (1, 2):
        files.publish(spark.createDataFrame([(v,)], "n int"), str(tmp_path / "s"), v)
    assert [r["n"] for r in files.latest(spark, str(tmp_path / "s")).collect()] == [2]
    rows = spark.createDataFrame([(1.0, "decision", "x7", 3)], "recorded_at double, kind string, decision_id string, size int")
    files.append_events(files.event_records(rows, ["decision_id", "size"]), str(tmp_path / "log"))
    r = spark.read.parquet(str(tmp_path / "log")).first()
    assert r["trace_id"] == "x7" and json.loads(r["payload"]) == {"decision_id": "x7", "size": 3} and len(r["event_id"]) == 64


def test_flow_files_and_policy_lists(spark, tmp_path):
    (tmp_path / "cam_2016-09-23.csv").write_text("time,dstIp\n5,1.1.1.1\n")
    schema = T.StructType([T.StructField("time", T.DoubleType()), T.StructField("dstIp", T.StringType())])
    whole = gzip.compress(b"time,dstIp\n" + b"6,1.1.1.2\n" * 5000)
    (tmp_path / "plug_2016-09-24.csv.gz").write_bytes(whole)
    (tmp_path / "broken_2016-09-25.csv.gz").write_bytes(whole[:-20])
    (tmp_path / "text_2016-09-26.csv.gz").write_bytes(b"time,dstIp\n7,1.1.1.3\n")
    (tmp_path / "header_2016-09-27.csv").write_bytes(b"time,\xff\xfe\n8,1.1.1.4\n")
    got, skipped = files.flow_files(spark, str(tmp_path / "*.csv*"), schema)
    assert {r["file"]: r["count"] for r in got.groupBy("file").count().collect()} == {"cam_2016-09-23.csv": 1, "plug_2016-09-24.csv.gz": 5000}
    assert {r["file"] for r in skipped.collect()} == {"broken_2016-09-25.csv.gz", "text_2016-09-26.csv.gz", "header_2016-09-27.csv"}
    (tmp_path / "policy.json").write_text(json.dumps({"permissions": [{"initiator": "a"}, {"initiator": "b"}]}, indent=1))
    nested = T.StructType([T.StructField("permissions", T.ArrayType(T.StructType([T.StructField("initiator", T.StringType())])))])
    got = files.nested_list(spark, str(tmp_path / "policy.json"), nested, "permissions").collect()
    assert [(r["ordinal"], r["initiator"]) for r in got] == [(0, "a"), (1, "b")]


def test_nested_documents_are_bounded_and_ordinals_go_on(spark, tmp_path):
    from fluxprint.plans import sources

    rows = [(i, 1 if i % 3 else 2, float(i)) for i in range(100)] + [(200, None, 1.0), (205, None, 2.0)]
    documents = sources.sliced_documents(spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double"), 8)
    assert documents.selectExpr("max(size(permissions))").first()[0] <= 8
    documents.write.json(str(tmp_path / "documents"))
    schema = "permissions array<struct<event_id: bigint, user_id: bigint, value: double, slice: bigint>>"
    got = sources.whole_ordinals(files.nested_list(spark, str(tmp_path / "documents"), schema, "permissions", lines=True)).collect()
    want = {e: sum(1 for f, v, _ in rows if v == u and f < e) for e, u, _ in rows}
    assert len(got) == len(rows) and {r.event_id: r.ordinal for r in got} == want


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    files.publish(spark.range(3), path, 1)
    # rows of a version that is still being written, and of a writer that has died
    spark.range(9).write.parquet(f"{path}/rows/version-2-dead")
    assert files.latest(spark, path).count() == 3
    with pytest.raises(Exception, match="lost"):
        files.publish(spark.range(1).select(F.raise_error(F.lit("lost"))), path, 2)
    assert files.latest(spark, path).count() == 3
    files.publish(spark.range(5), path, 2)
    assert files.latest(spark, path).count() == 5
    with pytest.raises(FileExistsError):
        files.publish(spark.range(7), path, 2)
    assert files.latest(spark, path).count() == 5
    files.publish(spark.range(4), path, 11)
    assert files.latest(spark, path).count() == 4
