"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles; the c-th occurrence of a shingle is an
element of its own, so that the weighted Jaccard similarity is that of the element sets. Each
element owns the region [0, infinity) of ranks, cut into unit cells; a hash of element and cell
says how many darts hit it (Poisson, mean 1), with which ranks and which coordinates. A
document of W elements throws the darts of rank under t / W, about t in all, and keeps the
earliest of each coordinate; equal darts in two documents are equal in rank, so a coordinate
agrees with the probability of their similarity.

Equal documents are folded first. Representatives that share a band are candidates: all pairs
of a small bucket; in a large one each member against the members closest to the bucket's
modal signature. Candidates whose signatures agree well enough are compared exactly.

The centres only save work. What a large bucket holds besides its main component, linked so far,
meets all of the bucket at last: both sides are cut into blocks, every two blocks are a group of their
own, and only a spanning forest of the links found leaves it. So two documents that share a
band are in one class whenever their signatures agree and they are similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxprint.llm import blocks
from fluxprint.llm.common import components, join_ids
from fluxprint.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5          # at similarity 0.8 a pair shares no band in 5 of 100,000 cases
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (np.log(COORDINATES) + 4)
LEAST_AGREEMENT = 0.66       # of the coordinates: four standard deviations under SIMILARITY
SMALL = 16                   # bucket size up to which all pairs are compared
CENTRES = 2                  # per large bucket
SAMPLED = 32                 # signatures that give a large bucket's mode
BLOCK = 1024                 # members of a block, fewer if they are long: ...
BLOCK_ELEMENTS = 1 << 20     # ... elements of a block, on average
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(14)])


def elements(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) sorted by document; repeated shingles of a document are told apart by their count."""
    doc, shingle = blocks.shingles(hashes, first, SHINGLE)
    if not len(doc):
        return doc, shingle
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])))
    heads = np.flatnonzero(fresh)
    layer = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(doc))))
    return doc, blocks.mix(shingle + layer.astype(np.uint64) * _STEP)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def throw(doc: np.ndarray, element: np.ndarray, reach: np.ndarray, earliest: np.ndarray) -> None:
    """Lower ``earliest`` (documents x coordinates) by all darts of rank under the document's reach."""
    cells = np.ceil(reach[doc]).astype(np.int64)
    owner = np.repeat(np.arange(len(doc)), cells)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    seed = blocks.mix(element[owner] + cell.astype(np.uint64) * _STEP)
    darts = np.searchsorted(_POISSON, _unit(seed), "right")
    thrown = np.repeat(np.arange(len(owner)), darts)
    number = np.arange(len(thrown)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = blocks.mix(seed[thrown] ^ ((number + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    rank = cell[thrown] + _unit(dart)
    of = doc[owner[thrown]]
    keep = np.flatnonzero(rank < reach[of])
    dart, of = dart[keep], of[keep]
    # rank in fixed point above, some of the dart's bits below: one comparison finds the earliest
    packed = ((rank[keep] * 2.0 ** 26).astype(np.uint64) << np.uint64(24)) | (dart >> np.uint64(40))
    coordinate = (blocks.mix(dart + _STEP) % np.uint64(COORDINATES)).astype(np.int64)
    np.minimum.at(earliest.reshape(-1), of * COORDINATES + coordinate, packed)


def signatures(doc: np.ndarray, element: np.ndarray, n_docs: int) -> np.ndarray:
    """uint32, documents x coordinates; documents without elements have zeros."""
    out = np.zeros((n_docs, COORDINATES), np.uint32)
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    for lo in range(0, n_docs, 256):
        hi = min(lo + 256, n_docs)
        d, e = doc[cut[lo]:cut[hi]] - lo, element[cut[lo]:cut[hi]]
        size = np.diff(cut[lo:hi + 1])
        reach = DARTS / np.maximum(size, 1)
        left = np.flatnonzero(size > 0)
        earliest = np.full((hi - lo, COORDINATES), np.iinfo(np.uint64).max, np.uint64)
        while len(left):
            wanted = np.isin(d, left) if len(left) < hi - lo else slice(None)
            throw(d[wanted], e[wanted], reach, earliest)
            left = left[(earliest[left] == np.iinfo(np.uint64).max).any(1)]
            reach = reach * 2
        out[lo:hi] = (blocks.mix(earliest) >> np.uint64(32)).astype(np.uint32)
        out[lo:hi][size == 0] = 0
    return out


SIGNED = "doc_id bigint, key_a bigint, key_b bigint, n bigint, sig binary"


def signed(docs: DataFrame) -> DataFrame:
    """Per row its id, a 128-bit key of its elements, their number and its signature."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in blocks.slices(batch.column(1)):
                _, _, hashes, first = blocks.words(data, at)
                doc, element = elements(hashes, first)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                keys = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(blocks.mix(element ^ np.uint64(salt)), dtype=np.uint64)))
                    keys.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(keys[0]), pa.array(keys[1]), pa.array(np.diff(cut)),
                     pa.array([row.tobytes() for row in signatures(doc, element, hi - lo)], pa.binary())],
                    names=["doc_id", "key_a", "key_b", "n", "sig"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, SIGNED)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


def banded(sigs: DataFrame) -> DataFrame:
    """(band, doc_id): one row per representative and band."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _sigs(batch.column(1)).astype(np.uint64).reshape(-1, BANDS, ROWS)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
            for j in range(ROWS):
                h = blocks.mix(h * _STEP + sig[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))],
                names=["band", "doc_id"])

    return sigs.select("doc_id", "sig").mapInArrow(scan, "band bigint, doc_id bigint")


def all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a < b) within the buckets of (band, doc_id) rows."""
    lists = rows.groupBy("band").agg(F.sort_array(F.collect_set("doc_id")).alias("m"))
    return lists.select(F.expr("""explode(flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b)))))""").alias("p")) \
        .select("p.a", "p.b").distinct()


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in LEAST_AGREEMENT of the coordinates."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch.column(0)):
                good = (_sigs(batch.column(2)) == _sigs(batch.column(3))).mean(1) >= LEAST_AGREEMENT
                yield batch.filter(pa.array(good)).select(["a", "b"])

    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a") \
        .join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(scan, "a bigint, b bigint")


def bags_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, elements) of the documents named: their elements, sorted, 32 bits each."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in blocks.slices(batch.column(1)):
                _, _, hashes, first = blocks.words(data, at)
                doc, element = elements(hashes, first)
                short = (element >> np.uint64(32)).astype(np.uint32)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([np.sort(short[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["doc_id", "elements"])

    return materialize(join_ids(docs.select(F.col("doc_id").cast("bigint"), "text"), ids, "left_semi").mapInArrow(
        sets, "doc_id bigint, elements binary"), "elements")


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose weighted Jaccard similarity, computed from the texts, is SIMILARITY or more."""
    pairs = materialize(pairs, "candidates")
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidate-ids")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(common >= SIMILARITY * (len(both) - common))
            if good:
                yield batch.filter(pa.array(good)).select(["a", "b"])

    bags = bags_of(docs, ids)
    both = pairs.join(bags.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a") \
        .join(bags.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(similar, "a bigint, b bigint").distinct()


def centres(members: DataFrame) -> DataFrame:
    """(band, centre) from (band, doc_id, sig): of each bucket the members closest to its mode.

    The mode is taken per coordinate from a bounded sample, one member for each of SAMPLED hash
    classes; the closest are sought among all members, one for each of CENTRES classes.
    """
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED))
    sample = members.groupBy("band", pick.alias("k")).agg(F.min(F.struct("doc_id", "sig")).alias("s")) \
        .groupBy("band").agg(F.collect_list("s.sig").alias("sigs"))

    def mode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sigs in batch.column(1):
                grid = np.sort(_sigs(sigs.values), 0)
                same = np.zeros((COORDINATES, len(grid)), np.int64)
                for i in range(1, len(grid)):  # length of the run of equal values that ends here
                    same[:, i] = np.where(grid[i] == grid[i - 1], same[:, i - 1] + 1, 0)
                out.append(grid[same.argmax(1), np.arange(COORDINATES)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["band", "mode"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (_sigs(batch.column(2)) == _sigs(batch.column(3))).sum(1) if len(batch.column(0)) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32))], names=["band", "doc_id", "agree"])

    near = members.join(sample.mapInArrow(mode, "band bigint, mode binary"), "band").select("band", "doc_id", "sig", "mode") \
        .mapInArrow(close, "band bigint, doc_id bigint, agree int")
    return near.groupBy("band", F.pmod(F.xxhash64(F.lit("centre"), "doc_id"), F.lit(CENTRES)).alias("k")) \
        .agg(F.min(F.struct(-F.col("agree"), "doc_id")).alias("c")).select("band", F.col("c.doc_id").alias("centre"))


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links that join what the earlier ones have not joined."""
    at, keep = {}, []

    def root(x: int) -> int:
        while at.get(x, x) != x:
            at[x] = at.get(at[x], at[x])
            x = at[x]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            at[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def met(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the members of two blocks that are in different components, as a spanning forest.

    The columns are band, both blocks, id, component, signature and elements, by place.
    """
    ids = [t.column(3).to_numpy() for t in (left, right)]
    part = [t.column(4).to_numpy() for t in (left, right)]
    sig = [np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint32).reshape(-1, COORDINATES) for t in (left, right)]
    low = [np.ascontiguousarray(s.astype(np.uint8).T) for s in sig]  # agree wherever the whole values do
    bags = [[np.frombuffer(x, np.uint32) for x in t.column(6).to_pylist()] for t in (left, right)]
    size = [np.array([len(x) for x in b], np.int64) for b in bags]
    a, b = [], []
    for lo in range(0, len(ids[0]), 64):
        hi = min(lo + 64, len(ids[0]))
        n = np.zeros((hi - lo, len(ids[1])), np.uint8)
        for x, y in zip(low[0], low[1]):
            n += x[lo:hi, None] == y
        n[part[0][lo:hi, None] == part[1]] = 0
        for i in range(lo, hi):
            js = np.flatnonzero(n[i - lo] >= LEAST_AGREEMENT * COORDINATES)
            js = js[(sig[1][js] == sig[0][i]).mean(1) >= LEAST_AGREEMENT]
            js = js[np.minimum(size[1][js], size[0][i]) >= SIMILARITY * np.maximum(size[1][js], size[0][i])]
            for j in js:
                both = np.concatenate((bags[0][i], bags[1][j]))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common >= SIMILARITY * (len(both) - common):
                    a.append(ids[0][i])
                    b.append(ids[1][j])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    keep = forest(a, b)
    a, b = a[keep], b[keep]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def remaining(large: DataFrame, sigs: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of the members of large buckets (band, doc_id) that the links so far leave outside their bucket's main component."""
    part = materialize(components(links), "parts")
    placed = large.join(part, large["doc_id"] == part["node"], "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    placed = materialize(placed.join(sigs.select("doc_id", "n"), "doc_id"), "placed")
    held = materialize(placed.groupBy("band", "part").agg(F.count("*").alias("size"), F.sum("n").alias("n")), "parts-of-buckets")
    total = held.groupBy("band").agg(F.max(F.struct("size", "n", "part")).alias("main"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.count("*").alias("parts")) \
        .filter("parts > 1")
    cut = lambda size, n: F.ceil(F.greatest(size / BLOCK, n / BLOCK_ELEMENTS, F.lit(1))).cast("int")
    # blocks 0 to few - 1 hold what is outside the main component, those to most - 1 the main component
    plan = materialize(total.select("band", F.col("main.part").alias("main"), cut(F.col("size") - F.col("main.size"), F.col("n") - F.col("main.n")).alias("few"),
                                    cut(F.col("main.size"), F.col("main.n")).alias("rest")), "block-plan")
    deal = lambda n: F.pmod(F.xxhash64(F.lit("block"), "doc_id"), n).cast("int")
    rows = placed.join(plan, "band").withColumn(
        "block", F.when(F.col("part") != F.col("main"), deal(F.col("few"))).otherwise(F.col("few") + deal(F.col("rest"))))
    rows = materialize(rows.select("band", "doc_id", "part", "block", "few", (F.col("few") + F.col("rest")).alias("most")), "blocks")
    ids = materialize(rows.select("doc_id").distinct(), "block-ids")
    whole = materialize(sigs.select("doc_id", "sig").join(bags_of(docs, ids), "doc_id"), "block-members")
    full = lambda r: r.join(whole, "doc_id").select("band", "l", "r", "doc_id", "part", "sig", "elements")
    left = full(rows.filter("block < few").withColumn("l", F.col("block")).withColumn("r", F.explode(F.expr("sequence(block, most - 1)"))))
    right = full(rows.withColumn("r", F.col("block")).withColumn("l", F.explode(F.expr("sequence(0, least(block, few - 1))"))))
    right = right.select(*[F.col(c).alias(f"{c}_right") for c in right.columns])
    return materialize(left.groupBy("band", "l", "r").cogroup(right.groupBy("band_right", "l_right", "r_right")).applyInArrow(met, "a bigint, b bigint").distinct(), "links")


def linked(docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Links (a, b) between representatives, all of SIMILARITY or more."""
    bands = materialize(banded(sigs), "bands")
    sizes = materialize(bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "bucket-sizes")
    pairs = all_pairs(bands.join(sizes.filter(F.col("size") <= SMALL), "band"))
    large = materialize(bands.join(sizes.filter(F.col("size") > SMALL), "band").select("band", "doc_id"), "large-buckets")
    crowded = large.head(1)
    if crowded:
        hubs = materialize(centres(large.join(sigs.select("doc_id", "sig"), "doc_id").select("band", "doc_id", "sig")), "centres")
        star = large.join(hubs, "band").filter("doc_id <> centre")
        pairs = pairs.union(star.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))).distinct()
    links = materialize(compared(agreeing(pairs, sigs), docs), "links")
    return links.union(remaining(large, sigs, links, docs)) if crowded else links


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) of each document; class_id is the smallest id that links reach.

    Documents of fewer than five words have one shingle of them all, so they link only to equal
    ones; null texts and texts without words are classes of their own. Rows with a null id are
    left out; repeated rows of an id are one document.
    """
    rows = materialize(signed(docs.filter("doc_id is not null")), "signatures")
    keyed = rows.filter("n > 0")
    # stored, so that the join below is dealt out for itself and a key of many copies can be split
    first = materialize(keyed.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("first")), "first-copies")
    copies = materialize(keyed.select("doc_id", "key_a", "key_b").join(first, ["key_a", "key_b"]).select("doc_id", "first").distinct(), "copies")
    sigs = materialize(keyed.join(first.select(F.col("first").alias("doc_id"), "key_a", "key_b"), ["doc_id", "key_a", "key_b"]).select("doc_id", "n", "sig")
                       .dropDuplicates(["doc_id"]), "representatives")
    same = copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    links = linked(docs, sigs)
    found = components(links if _single(copies) else links.union(same))
    at = copies.groupBy("doc_id").agg(F.min("first").alias("first")).join(found, F.col("first") == F.col("node"), "left") \
        .select("doc_id", F.coalesce("component", "first").alias("class_id"))
    ids = rows.select("doc_id").distinct()
    return ids.join(at, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")) \
        .withColumn("kept", F.col("doc_id") == F.col("class_id"))


def _single(copies: DataFrame) -> bool:
    """Whether each id has one text, so that copies need no links of their own."""
    return not copies.groupBy("doc_id").count().filter("count > 1").head(1)


def clean(docs: DataFrame) -> DataFrame:
    """One document of each class, all columns as they are; rows with a null id stay."""
    out = materialize(classes(docs).filter("not kept").select("doc_id"), "near-copies")
    return join_ids(docs, out, "left_anti").select(*docs.columns)
