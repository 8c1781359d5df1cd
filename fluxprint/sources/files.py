"""Structured file sources and sinks."""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxprint.functions.scalars import digest
from fluxprint.operators import policy
from fluxprint.operators.evidence import trace_id
from fluxprint.operators.profile import Profile
from fluxprint.schemas import IDENTITY
from fluxprint.session import materialize

PIECE = 1 << 20  # bytes of a flow file looked at together

# Numeric and categorical columns of a device-day flow file.
FLOW_NUMERIC = ["srcNumPackets", "dstNumPackets", "srcPayloadSize", "dstPayloadSize", "srcAvgPayloadSize", "dstAvgPayloadSize",
                "srcMaxPayloadSize", "dstMaxPayloadSize", "srcStdDevPayloadSize", "dstStdDevPayloadSize", "flowDuration",
                "srcAvgInterarrivalTime", "dstAvgInterarrivalTime", "avgInterarrivalTime", "srcStdDevInterarrivalTime",
                "dstStdDevInterarrivalTime"]
FLOW_CATEGORICAL = ["ipProto", "protocol", "allMatchedProtocols"]


# A4
def evaluation_records(spark: SparkSession, path: str, schema: T.StructType, array: bool) -> DataFrame:
    """Records from a JSON array file or from JSON lines; anything but objects fails."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", array).json(path)


# A5
def flow_files(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of device-day CSV files by header name, and the files that were skipped with the reason.

    A file is skipped as a whole, so that a broken one does not pass for a short one. Each is
    looked through once before, piece by piece in a task of its own, whatever its size.
    """
    listed = spark.read.format("binaryFile").load(path).select("path")
    skipped = materialize(listed.repartition("path").mapInArrow(_look_through, "file string, reason string"), "skipped-files")
    rows = (spark.read.option("header", True).option("enforceSchema", False).option("ignoreCorruptFiles", True)
            .schema(schema).csv(path).select("*", F.col("_metadata.file_name").alias("file")))
    return rows.join(skipped.select("file"), "file", "left_anti").select(*schema.names, "file"), skipped


def _look_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, reason) of files that do not inflate to their end or whose header is not text."""
    for batch in batches:
        bad = []
        for path in batch.column(0).to_pylist():
            try:
                _inflates(path)
            except (OSError, EOFError, zlib.error, UnicodeDecodeError) as e:
                bad.append((path.rsplit("/", 1)[-1], str(e)))
        yield pa.RecordBatch.from_pydict({"file": pa.array([b[0] for b in bad], pa.string()), "reason": pa.array([b[1] for b in bad], pa.string())})


def _inflates(path: str) -> None:
    store, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    packed = path.endswith(".gz")  # as the reader of the rows decides
    with store.open_input_stream(place, compression=None) as raw, (gzip.GzipFile(fileobj=raw) if packed else raw) as text:
        text.read(PIECE).split(b"\n")[0].decode()
        while packed and text.read(PIECE):
            pass


# A7
def permission_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Facts of permission documents, one document per file."""
    text = spark.read.text(path, wholetext=True)
    return policy.document_facts(text.select(F.col("_metadata.file_name").alias("document_id"), F.col("value").alias("text")))


# A8
def nested_list(spark: SparkSession, path: str, schema: T.StructType | str, field: str, lines: bool = False) -> DataFrame:
    """One row per entry of a list inside a JSON document, with its place in the list; a document per file or per line."""
    documents = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return documents.select(F.posexplode(field).alias("ordinal", "_item")).select("ordinal", "_item.*")


# A9
def merged_events(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, array: bool = True) -> DataFrame:
    """Per-device dumps as one table in time order; the sort is a distributed range sort.

    Array files are read whole by a task each; large dumps should be JSON lines.
    """
    return spark.read.schema(schema).option("multiLine", array).json(list(paths)).orderBy("timestamp")


# A10
def write_windows(windows: DataFrame, path: str, fmt: str = "parquet", pieces: int = 8) -> None:
    """Windows by day, in ``pieces`` files a day at most; a device's windows of a day lie together in one of them."""
    dated = windows.withColumn("day", F.floor(F.col("window_start") / 86_400).cast("int"))
    dated.repartition("day", F.pmod(F.hash("device"), F.lit(pieces))).sortWithinPartitions("day", "device", "window_start") \
        .write.mode("overwrite").partitionBy("day").format(fmt).save(path)


def write_profile(profile: Profile, path: str) -> None:
    """One folder per table; the observation table carries the frozen mark."""
    for name, table in vars(profile).items():
        if table is not None:
            frozen = table.withColumn("frozen", F.lit(True)) if name == "observation" else table
            frozen.write.mode("overwrite").parquet(f"{path}/{name}")


# A6
def read_profile(spark: SparkSession, path: str, calibrated: bool = True) -> Profile:
    """A stored profile; rows not marked frozen make any use of it fail."""
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    seen = table("observation")
    if "frozen" not in seen.columns:
        raise ValueError("the profile is not marked frozen")
    mark = F.assert_true(F.coalesce("frozen", F.lit(False)), "the profile is not marked frozen")
    checked = seen.withColumn("_ok", mark).filter("_ok is null").drop("_ok", "frozen")
    extra = [table(n) for n in ("calibration", "baseline_scores")] if calibrated else [None, None]
    return Profile(checked, table("stats"), table("services"), table("hours"), table("endpoints"), *extra)


# A11
def publish(df: DataFrame, path: str, version: int) -> None:
    """Write a whole snapshot as a version that readers see at once or not at all.

    The rows go to a folder of their own; a manifest that names it is then renamed into place. A
    writer that fails leaves a folder that no manifest names. A version can be published once: the
    second of two writers gets an error and changes nothing.
    """
    spark = df.sparkSession
    folder = f"version-{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/rows/{folder}")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    commits = hadoop.Path(f"{path}/commits")
    fs = commits.getFileSystem(conf)
    draft, final = hadoop.Path(commits, f"_{folder}"), hadoop.Path(commits, f"{version:020d}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise FileExistsError(f"version {version} of {path} is published already")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest published snapshot; what has no manifest is not looked at."""
    commits = spark.read.text(f"{path}/commits").select("value", F.col("_metadata.file_name").alias("name"))
    folder = commits.agg(F.max_by("value", "name")).first()[0]
    return spark.read.parquet(f"{path}/rows/{folder}")


# A12
def event_records(rows: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Log records ``recorded_at, kind, trace_id, payload, event_id``; works on streams too."""
    missing = [F.lit(None).cast("string").alias(c) for c in IDENTITY if c not in rows.columns]
    named = rows.select("*", *missing)
    record = named.select("recorded_at", "kind", trace_id(named.columns).alias("trace_id"),
                          F.to_json(F.struct(*sorted(payload))).alias("payload"))
    return record.withColumn("event_id", digest("recorded_at", "kind", "trace_id", "payload"))


def append_events(records: DataFrame, path: str, checkpoint: str | None = None):
    """Append to the log: an exactly-once stream, or a batch write that leaves out events which the log holds.

    A batch is compared by ``event_id`` with the log's events of its own span of ``recorded_at``
    (rows without a time with those without one), so a repeated batch adds nothing and what is read
    follows the batch. Two batches at the same moment don't see each other.
    """
    if records.isStreaming:
        return (records.writeStream.outputMode("append").format("parquet").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    fresh = records.dropDuplicates(["event_id"])
    try:
        log = records.sparkSession.read.schema(records.schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        lo, hi = records.agg(F.min("recorded_at"), F.max("recorded_at")).first()
        span = F.col("recorded_at").isNull() if lo is None else F.col("recorded_at").isNull() | F.col("recorded_at").between(lo, hi)
        fresh = fresh.join(log.filter(span).select("event_id"), "event_id", "left_anti").select(records.columns)
    return fresh.write.mode("append").parquet(path)


# A13
def known_packets(packets: DataFrame, known: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Packets from or to a known address, timed from the first one kept; and how many were not.

    ``known`` is a list of addresses of an inventory; the earliest time is one
    aggregate, not a global window.
    """
    ips = known.select("ip").distinct()
    tagged = packets.join(ips.select(F.col("ip").alias("source"), F.lit(True).alias("_s")), "source", "left").join(
        ips.select(F.col("ip").alias("destination"), F.lit(True).alias("_d")), "destination", "left")
    touches = F.coalesce(F.col("_s"), F.col("_d"), F.lit(False))
    kept = tagged.filter(touches).drop("_s", "_d")
    first = kept.orderBy("number").select("timestamp").limit(1).scalar()
    kept = kept.withColumn("relative_time", F.col("timestamp") - first)
    if limit is not None:
        kept = kept.orderBy("number").limit(limit)
    return kept, tagged.agg(F.count_if(~touches).alias("skipped"))
