"""Which of several document filters removes what, in every order of the filters.

Each document gets one bit per filter that it fails. Four filters read the document alone. The
fifth asks whether an equal text exists under a smaller id: a left-semi join of the documents
with themselves on the hash, the exact text and the smaller id. The ids that fail it are united
with the other failures and folded into one combination of bits per document; all that is said
about orders, overlaps and shares is then arithmetic on at most 32 counts per part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxprint.llm.common import join_ids, text_bytes
from fluxprint.session import materialize

FILTERS = "ABCDE"
FEWEST_WORDS = 200
LEAST_DISTINCT = 50            # per cent of the words
MOST_CAPITALS = 3              # per cent of the code points
MARKS = b"#$%&*|"
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_CAPITALS = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))      # bytes that go on with a code point


def pieces(raw: bytes, most: int = PIECE) -> Iterator[bytes]:
    """``raw`` in pieces of about ``most`` bytes, cut before a space so that no word is torn."""
    at = 0
    while len(raw) - at > most:
        cut = _SPACE.search(raw, at + most)
        if cut is None:
            break
        yield raw[at:cut.start()]
        at = cut.start()
    yield raw[at:] if at else raw


def own_failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = capitals = points = marks = 0
    for piece in pieces(raw):
        n = len(piece)
        words += len(piece.split())
        capitals += n - len(piece.translate(None, _CAPITALS))
        points += len(piece.translate(None, _CONTINUED))
        marks += n - len(piece.translate(None, MARKS))
    distinct: set[bytes] = set()
    for piece in pieces(raw):
        distinct.update(piece.split())
        if 100 * len(distinct) >= LEAST_DISTINCT * words:
            break
    return ((words < FEWEST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * words) << 1
            | (100 * capitals > MOST_CAPITALS * points) << 2 | (marks > 0) << 3)


def keyed(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """``doc_id, part, digest, raw`` of each row; what else the table holds is left behind."""
    raw = text_bytes(F.col(f"`{text}`"))
    return docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.xxhash64(raw).alias("digest"), raw.alias("raw"))


def failures(rows: DataFrame) -> DataFrame:
    """Each row of :func:`keyed` with ``bits`` of A to D in place of its text."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([own_failures(x.as_py()) for x in batch.column(3)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [bits], names=["doc_id", "part", "digest", "bits"])

    return rows.mapInArrow(judge, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, digest bigint, bits int")


def repeats(rows: DataFrame) -> DataFrame:
    """The rows of :func:`keyed` whose text stands under a smaller id too (filter E), without their texts.

    Only texts whose hash is shared by several ids move. The smaller side of the join is folded
    first, to the smallest id of each text, so a text with a third of all rows is one row there,
    and stored, so that AQE can split such a text's rows on the other side.
    """
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("digest")
    again = join_ids(rows, materialize(several, "shared-digests"), "left_semi", "digest")
    first = materialize(again.groupBy("digest", "raw").agg(F.min("doc_id").alias("first_id")), "first-ids")
    same = (again["digest"] == first["digest"]) & (again["raw"] == first["raw"]) & (first["first_id"] < again["doc_id"])
    return again.join(first, same, "left_semi").drop("raw")


def combinations(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, bits, n, good, toxic``: documents of each part by the set of filters they fail (bit 0 is A).

    A null text is empty; a null part is the empty string. Rows that repeat an id count each; they
    are no repeats of one another. A null id neither repeats another document nor is repeated.
    A document is good or toxic if any of its label rows says so. An empty table has no rows.
    """
    rows = keyed(docs, id, text, part)
    failed = failures(rows).withColumn("n", F.lit(1)).unionByName(
        repeats(rows).withColumns({"bits": F.lit(1 << FILTERS.index("E")), "n": F.lit(0)}))
    folded = failed.groupBy("doc_id", "part", "digest").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return folded.join(told, "doc_id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def interactions(combos: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every step of every order of ``filters`` keeps, removes and duplicates, per part.

    ``combos`` is :func:`combinations`, stored as it is read twice; each of its rows meets the steps
    of all orders, 600 for five filters, a number that no table changes.
    """
    combos = materialize(combos, "filter-combinations")
    orders = " ".join("".join(p) for p in permutations(filters))
    steps = combos.select("*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("step", "filter"))

    def mask(letters: F.Column) -> F.Column:
        return F.aggregate(F.split(letters, ""), F.lit(0), lambda m, x: F.when(x == "", m).otherwise(
            m.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), x) - 1))))

    marked = steps.withColumns({"step": F.col("step") + 1, "before": mask(F.expr("left(filter_order, step)")), "bit": mask(F.col("filter"))})
    fails, gone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    table = marked.groupBy("part", "filter_order", "step", "filter").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("bits") == F.col("bit")).alias("unique_fails"), count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"))
    share = table.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return table.join(share, ["part", "filter"])
