"""Removal of long repeats: bytes covered by a SPAN-byte string that also starts in a smaller document.

Every SPAN-byte window has an anchor, the KMER-byte string with the smallest hash in it, so
equal windows have equal anchors. Windows in a row with the same anchor form a phrase; phrases
overlap by SPAN - 1 bytes and a window lies in one of them only. So:

1. each scan partition (a block) sends the hashes of its anchors, by shard of the hash;
   a shard tells each block which of its anchors also occur in other documents;
2. the block's phrases at such anchors, each distinct one once with the smallest document that
   holds it, go to the anchor's shard;
3. the shard builds a run-length index of the distinct phrases whose anchor has several of them and
   marks the windows that a phrase with a smaller document also holds (:mod:`runindex`); an anchor with a single
   phrase needs none, as all its windows recur whole;
4. a window of a document is repeated if the document is not the phrase's first, or if it is
   marked; the block adds up the bytes that repeated windows cover.

Only hashes and repeated phrases move between shards, sorted and compressed, and the texts
twice, compressed, to meet the answers of their block. Nothing is sampled or capped, and a passage in
a third of all documents is one phrase per block. ``docs`` is scanned three times and must be a stored
table, so that its partitions hold the same rows each time; a lost executor's blocks are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxprint.llm import blocks, runindex
from fluxprint.llm.runindex import SPAN
from fluxprint.session import materialize

KMER = 24
REACH = SPAN - KMER + 1              # k-mers in a window, and windows of a phrase at most
FLUSH_ANCHORS = 1 << 21
FLUSH_BYTES = 1 << 24
INDEX_WINDOWS = 1 << 17              # anchors are indexed together up to so many windows
PART_PHRASES = 1 << 19               # phrases of a shard that are worked on together, about; an anchor stays whole
GATHER_BYTES = 1 << 18
CLASS_WINDOWS = 1 << 21              # windows of a crowded anchor that are compared together, about
_PLACE = np.uint64((1 << 28) - 1)
_LOW = np.uint64(0xFFFFFFFF)


def phrases(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, windows, anchor hash, phrase hash and document of all phrases of the texts in ``data``."""
    n = len(data)
    if n < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    if n > int(_PLACE):
        raise ValueError("a text of more than 256 MB")
    power, inverse = blocks._grown(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[:n], out=total[1:])
    kmer = (total[KMER:] - total[:-KMER]) * inverse[:n - KMER + 1]
    kmer ^= kmer >> np.uint64(32)
    kmer *= np.uint64(0xD6E8FEB86659FD93)
    least = (kmer & ~_PLACE) | np.arange(len(kmer), dtype=np.uint64)
    span = 1
    while 2 * span <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < REACH:
        least = np.minimum(least[:-(REACH - span)], least[REACH - span:])
    place = (least & _PLACE).astype(np.int64)
    size = np.diff(at)
    long = size >= SPAN
    edge = np.zeros(len(place) + 1, np.int32)
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - SPAN + 1, -1)
    fine = np.cumsum(edge[:-1]) > 0
    change = place[1:] != place[:-1]
    start = np.flatnonzero(fine & np.concatenate(([True], ~fine[:-1] | change)))
    end = np.flatnonzero(fine & np.concatenate((~fine[1:] | change, [True]))) + 1
    windows = end - start
    whole = blocks.mix((total[end + SPAN - 1] - total[start]) * inverse[start] + windows.astype(np.uint64))
    return start, windows, kmer[place[start]], whole, np.searchsorted(at, start, "right") - 1


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as compressed differences, byte plane by byte plane."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype(np.uint32)
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueeze(payload: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(payload, max_output_size=max(4 * n, 1)), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _shards(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Shard above, low half of the hash below: one sortable number."""
    return (((anchor >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32)) | (anchor & _LOW)


def _segments(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of sorted keys."""
    of = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(keys))):
        if hi > lo:
            yield int(of[lo]), int(lo), int(hi)


def anchors(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, block, n, hashes, flags): the distinct anchors of a block; flagged are those of several of its documents."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen, block = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            keys, of = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(keys)
            keys, of = keys[order], of[order]
            heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            several = np.minimum.reduceat(of, heads) != np.maximum.reduceat(of, heads)
            keys = keys[heads]
            rows = [(s, block, hi - lo, squeeze((keys[lo:hi] & _LOW).astype(np.uint32)), np.packbits(several[lo:hi]).tobytes()) for s, lo, hi in _segments(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                             names=["shard", "block", "n", "hashes", "flags"])

        for batch in batches:
            for lo, hi, data, at in blocks.slices(batch.column(1)):
                block = batch.column(2)[0].as_py()
                _, _, anchor, _, doc = phrases(data, at)
                named = batch.column(0).slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)[doc]
                held.append((_shards(anchor[named], shards), (doc[named] + seen).astype(np.int32)))
                seen += hi - lo
                if sum(len(h[0]) for h in held) > FLUSH_ANCHORS:
                    yield from flush()
                    held = []
        if sum(len(h[0]) for h in held):
            yield from flush()

    return docs.select("doc_id", "text", F.spark_partition_id()).mapInArrow(scan, "shard int, block int, n int, hashes binary, flags binary")


def _values(column: pa.Array) -> list:
    """Python values; those of a binary column are views of the batch, not copies."""
    return [v.as_buffer() for v in column] if pa.types.is_binary(column.type) else column.to_pylist()


def _by_key(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that are sorted by their first column, gathered by it."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(_values(batch.column(c)) for c in columns)):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def shared_anchors(found: DataFrame, shards: int) -> DataFrame:
    """(block, shard, n, hashes): of a block's anchors those that occur in several documents."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_key(batches, "shard", "block", "n", "hashes", "flags"):
            hashes = [unsqueeze(r[3], r[2]) for r in rows]
            every = np.concatenate(hashes)
            several = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=r[2]) for r in rows])
            order = np.argsort(every)
            ranked = every[order]
            heads = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            group = np.cumsum(heads) - 1
            both = (np.bincount(group) > 1) | (np.bincount(group, several[order]) > 0)
            good = np.empty(len(every), bool)
            good[order] = both[group]
            cut = np.cumsum([0] + [len(h) for h in hashes])
            out = [(r[1], shard, h[good[lo:hi]]) for r, h, lo, hi in zip(rows, hashes, cut[:-1], cut[1:])]
            out = [(b, s, len(h), squeeze(h)) for b, s, h in out if len(h)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                                 names=["block", "shard", "n", "hashes"])

    return found.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(scan, "block int, shard int, n int, hashes binary")


def packed(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes, texts): the documents of a block, some 1 MB compressed together."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo, hi, data, at in blocks.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(lo, 1), pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                     pa.array([np.diff(at)], pa.list_(pa.int64())), pa.array([press.compress(data.tobytes())], pa.binary())],
                    names=["block", "ids", "sizes", "texts"])

    return docs.select("doc_id", "text", F.spark_partition_id()).mapInArrow(scan, "block int, ids array<bigint>, sizes array<bigint>, texts binary")


def _meet(answers: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """A block's answers (kind 0), then its texts (kind 1), in one task."""
    texts = packed(docs)
    left = [F.lit(None).cast(t).alias(c) for c, t in texts.dtypes if c != "block"]
    right = [F.lit(None).cast(t).alias(c) for c, t in answers.dtypes if c != "block"]
    both = answers.select("block", F.lit(0).alias("kind"), *[c for c in answers.columns if c != "block"], *left).union(
        texts.select("block", F.lit(1).alias("kind"), *right, "ids", "sizes", "texts"))
    return both.repartitionById(n, F.col("block")).sortWithinPartitions("block", "kind")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict]]:
    """(block, kind, row) of sorted rows; a row is a function from column name to value, so that only what is used is copied."""
    for batch in batches:
        of, kind = batch.column("block").to_pylist(), batch.column("kind").to_pylist()
        for i in range(batch.num_rows):
            yield of[i], kind[i], lambda name, i=i, batch=batch: batch.column(name)[i].as_py()


def _unpack(row) -> tuple[list, np.ndarray, np.ndarray]:
    at = np.concatenate(([0], np.cumsum(np.array(row("sizes"), np.int64))))
    data = np.frombuffer(zstandard.decompress(row("texts"), max_output_size=max(int(at[-1]), 1)), np.uint8)
    return row("ids"), data, at


class Members:
    """Membership and place of 64-bit keys in a sorted array, with a bitmap before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._low(keys)] = True

    @staticmethod
    def _low(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(32))) & np.uint64((1 << 22) - 1)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are members, where in the sorted array)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = np.flatnonzero(self.bits[self._low(keys)])
        place = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
        good = self.keys[place] == keys[hit]
        return hit[good], place[good]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given ranges of bytes one after the other, some at a time, as an index takes many times the bytes."""
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, data.dtype)
    lo = done = 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, done + GATHER_BYTES, "right")))
        upto = int(end[hi - 1])
        out[done:upto] = data[np.repeat(start[lo:hi] - (end[lo:hi] - size[lo:hi]), size[lo:hi]) + np.arange(done, upto)]
        lo, done = hi, upto
    return out


PHRASES = "shard int, block int, anchors binary, hashes binary, firsts binary, windows binary, texts binary"


def repeated_phrases(docs: DataFrame, shared: DataFrame, shards: int, n: int) -> DataFrame:
    """Distinct phrases of each block at shared anchors, with the smallest document that holds them, by shard."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, members, held, weight = None, [], None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, whole, first, windows = (np.concatenate([h[i] for h in held]) for i in range(4))
            data = np.concatenate([h[4] for h in held])
            order = np.lexsort((first, whole))
            order = order[np.concatenate(([True], whole[order][1:] != whole[order][:-1]))]
            order = order[np.argsort(key[order], kind="stable")]
            size = windows + SPAN - 1
            start = np.cumsum(size) - size
            rows = []
            for s, lo, hi in _segments(key[order]):
                mine = order[lo:hi]
                rows.append((s, block, (key[mine] & _LOW).astype(np.uint32).tobytes(), whole[mine].tobytes(), zstandard.compress(first[mine].tobytes(), 1),
                             windows[mine].astype(np.uint8).tobytes(), zstandard.compress(_gather(data, start[mine], size[mine]).tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 5))],
                                             names=["shard", "block", "anchors", "hashes", "firsts", "windows", "texts"])

        for of, kind, row in _walk(batches):
            if of != block:
                if held:
                    yield from flush()
                block, keys, members, held, weight = of, [], None, [], 0
            if kind == 0:
                keys.append((np.uint64(row("shard")) << np.uint64(32)) | unsqueeze(row("hashes"), row("n")).astype(np.uint64))
                continue
            if members is None:
                members = Members(np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64))
            ids, data, at = _unpack(row)
            start, windows, anchor, whole, doc = phrases(data, at)
            key = _shards(anchor, shards)
            hit, _ = members(key)
            number = np.array([-1 if i is None else i for i in ids], np.int64)
            null = np.array([i is None for i in ids], bool)
            hit = hit[~null[doc[hit]]]
            if not len(hit):
                continue
            hit = hit[np.lexsort((number[doc[hit]], whole[hit]))]
            hit = hit[np.concatenate(([True], whole[hit][1:] != whole[hit][:-1]))]
            held.append((key[hit], whole[hit], number[doc[hit]], windows[hit], _gather(data, start[hit], windows[hit] + SPAN - 1)))
            weight += len(held[-1][4])
            if weight > FLUSH_BYTES:
                yield from flush()
                held, weight = [], 0
        if held:
            yield from flush()

    return _meet(shared, docs, n).mapInArrow(scan, PHRASES)


def _window_hashes(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the windows of phrases that lie in ``text`` one after the other."""
    power, inverse = blocks._grown(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text + np.uint64(1)) * power[:len(text)], out=total[1:])
    windows = size - SPAN + 1
    start = np.repeat(np.cumsum(size) - size - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    return blocks.mix((total[start + SPAN] - total[start]) * inverse[start])


def _crowded(first: np.ndarray, windows: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks of the distinct phrases of one anchor, sorted by document, which are too many for one index.

    Equal windows have equal hashes, so windows are taken by classes of their hash. Those that share
    their hash with no other one can't recur and leave; the others are indexed some at a time, all of a hash together.
    """
    out = np.zeros(len(first), np.int64)
    size = windows + SPAN - 1
    end, upto = np.cumsum(size), np.cumsum(windows)
    classes = -(-int(upto[-1]) // CLASS_WINDOWS)
    for k in range(classes):
        parts, lo = [], 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + blocks.SLICE, "right")))
            base = int(end[lo] - size[lo])
            hashes = _window_hashes(text[base:int(end[hi - 1])], size[lo:hi])
            mine = np.flatnonzero(hashes % np.uint64(classes) == k)
            parts.append((hashes[mine], mine + (int(upto[lo - 1]) if lo else 0)))
            lo = hi
        hashes, number = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(hashes, kind="stable")
        hashes, number = hashes[order], number[order]
        same = hashes[1:] == hashes[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))
        hashes, number = hashes[several], number[several]
        heads = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        for lo, hi in _runs(np.append(heads, len(hashes)), INDEX_WINDOWS):
            held = np.zeros(0, np.int64)    # of a hash with more windows than that, those without a smaller document so far
            for a in range(lo, hi, INDEX_WINDOWS):
                mine = np.concatenate((held, number[a:min(a + INDEX_WINDOWS, hi)]))
                of = np.searchsorted(upto, mine, "right")
                step = mine - (upto[of] - windows[of])
                spans = np.full(len(mine), SPAN)
                marked = runindex.repeated(_gather(text, end[of] - size[of] + step, spans), spans, first[of]) > 0
                np.bitwise_or.at(out, of[marked], np.int64(1) << step[marked])
                held = mine[~marked]
    return out


def _runs(cuts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges between some of the sorted ``cuts``, of up to ``most``; what lies between two neighbours stays whole."""
    i = 0
    while i < len(cuts) - 1:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + most, "right")) - 1)
        yield int(cuts[i]), int(cuts[j])
        i = j


def _marks(key: np.ndarray, first: np.ndarray, windows: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks of distinct phrases that are sorted by anchor; anchors are indexed some at a time, as they share no window."""
    out = np.zeros(len(key), np.int64)
    size = windows + SPAN - 1
    end = np.cumsum(size)
    group = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    seen = np.concatenate(([0], np.cumsum(windows)))
    cuts = np.append(group, len(key))
    for lo, hi in _runs(seen[cuts], INDEX_WINDOWS):
        a, b = (int(x) for x in np.searchsorted(seen, (lo, hi)))
        one = _crowded if hi - lo > INDEX_WINDOWS else lambda first, windows, text: runindex.repeated(text, windows + SPAN - 1, first)
        out[a:b] = one(first[a:b], windows[a:b], text[end[a] - size[a]:end[b - 1]])
    return out


def _told(rows: list[tuple], anchors: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First document of all and marks of the phrases ``lo`` to ``hi`` of each row, row after row."""
    whole = [np.frombuffer(r[3], np.uint64)[i:j] for r, i, j in zip(rows, lo, hi)]
    cut = np.cumsum([0] + [len(w) for w in whole])
    whole = np.concatenate(whole)
    anchor = np.concatenate([a[i:j] for a, i, j in zip(anchors, lo, hi)])
    first = np.concatenate([np.frombuffer(zstandard.decompress(r[4]), np.int64)[i:j] for r, i, j in zip(rows, lo, hi)])
    windows = np.concatenate([np.frombuffer(r[5], np.uint8)[i:j] for r, i, j in zip(rows, lo, hi)]).astype(np.int64)
    distinct, at, back = np.unique(whole, return_index=True, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, back, first)
    # phrases alone at their anchor share no window with another one
    _, group, crowd = np.unique(anchor[at], return_inverse=True, return_counts=True)
    together = np.flatnonzero(crowd[group] > 1)
    together = together[np.lexsort((least[together], anchor[at][together]))]
    marks = np.zeros(len(distinct), np.int64)
    if len(together):
        wanted = np.zeros(len(whole), bool)
        wanted[at[together]] = True
        texts, offset, filled = [], np.zeros(len(whole), np.int64), 0
        for r, i, a, b in zip(rows, lo, cut[:-1], cut[1:]):
            mine = np.flatnonzero(wanted[a:b])
            if len(mine):
                here = np.frombuffer(r[5], np.uint8).astype(np.int64) + SPAN - 1
                start, mine = np.cumsum(here) - here, mine + i
                texts.append(_gather(np.frombuffer(zstandard.decompress(r[6]), np.uint8), start[mine], here[mine]))
                offset[a + mine - i] = filled + np.cumsum(here[mine]) - here[mine]
                filled += len(texts[-1])
        ordered = at[together]
        text = np.concatenate(texts)
        del texts
        text = _gather(text, offset[ordered], windows[ordered] + SPAN - 1)
        marks[together] = _marks(anchor[ordered], least[together], windows[ordered], text)
    return least[back], marks[back].astype(np.uint32)


def answered(found: DataFrame, shards: int) -> DataFrame:
    """(block, hashes, answers): for each phrase sent by a block its first document of all and the marks of its windows there.

    The phrases of a row are sorted by anchor; a shard is worked on by ranges of anchors, so that what its phrases take unpacked does not grow with it.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, "shard", "block", "anchors", "hashes", "firsts", "windows", "texts"):
            anchors = [np.frombuffer(r[2], np.uint32) for r in rows]
            base = np.cumsum([0] + [len(a) for a in anchors])
            least, marks = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.uint32)
            parts = -(-int(base[-1]) // PART_PHRASES)
            bounds = [(k << 32) // parts for k in range(parts + 1)]
            lo = np.zeros(len(rows), np.int64)
            for bound in bounds[1:]:
                hi = np.array([np.searchsorted(a, bound) for a in anchors])
                if (hi > lo).any():
                    told, cut = _told(rows, anchors, lo, hi), np.cumsum([0, *(hi - lo)])
                    for b, i, j, x, y in zip(base, lo, hi, cut[:-1], cut[1:]):
                        least[b + i:b + j], marks[b + i:b + j] = told[0][x:y], told[1][x:y]
                lo = hi
            for r, a, b in zip(rows, base[:-1], base[1:]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[1]], pa.int32()), pa.array([r[3].to_pybytes()], pa.binary()),
                     pa.array([zstandard.compress(least[a:b].tobytes() + marks[a:b].tobytes(), 1)], pa.binary())],
                    names=["block", "hashes", "answers"])

    return found.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(scan, "block int, hashes binary, answers binary")


def cover(start: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    edge[start] += 1
    edge[start + SPAN] -= 1
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the repeated byte ranges of each row (maximal, from, to) and the bytes that are left.

    Null texts are empty. A row with a null id is kept whole and makes no other row's bytes repeated. Rows
    with the same id repeat nothing of each other. Columns of the input besides doc_id and text are not used.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n = shards = max(1, docs._jdf.rdd().getNumPartitions())
    shared = materialize(shared_anchors(anchors(docs, shards), shards), "shared-anchors")
    answers = materialize(answered(repeated_phrases(docs, shared, shards, n), shards), "phrase-answers")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, members = None, [], None
        for of, kind, row in _walk(batches):
            if of != block:
                block, held, members = of, [], None
            if kind == 0:
                whole = np.frombuffer(row("hashes"), np.uint64)
                told = zstandard.decompress(row("answers"))
                held.append((whole, np.frombuffer(told, np.int64, len(whole)), np.frombuffer(told, np.uint32, offset=8 * len(whole))))
                continue
            if members is None:
                whole, first, marks = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.uint32)))
                whole, at = np.unique(whole, return_index=True)
                members, first, marks, held = Members(whole), first[at], marks[at], []
            ids, data, at = _unpack(row)
            start, windows, _, whole, doc = phrases(data, at)
            hit, place = members(whole)
            number = np.array([-1 if i is None else i for i in ids], np.int64)
            hit, place = (x[~np.array([i is None for i in ids], bool)[doc[hit]]] for x in (hit, place))
            bits = np.where(number[doc[hit]] > first[place], np.uint32(0xFFFFFFFF), marks[place])
            owner = np.repeat(np.arange(len(hit)), windows[hit])
            step = np.arange(len(owner)) - np.repeat(np.cumsum(windows[hit]) - windows[hit], windows[hit])
            on = (bits[owner] >> step.astype(np.uint32)) & 1 > 0
            gone = cover((start[hit][owner] + step)[on], len(data))
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            opened = np.flatnonzero(gone & (edge[:-1] | np.concatenate(([True], ~gone[:-1])))) if len(data) else np.zeros(0, np.int64)
            closed = np.flatnonzero(gone & (edge[1:] | np.concatenate((~gone[1:], [True])))) + 1 if len(data) else np.zeros(0, np.int64)
            kept, spans = data[~gone], np.searchsorted(opened, at)
            left = np.concatenate(([0], np.cumsum(~gone)))[at]
            pairs = [[{"start": int(a), "end": int(b)} for a, b in zip(opened[i:j] - base, closed[i:j] - base)] for i, j, base in zip(spans[:-1], spans[1:], at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(at)), pa.array(pairs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([kept[i:j].tobytes() for i, j in zip(left[:-1], left[1:])], pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    return _meet(answers, docs, n).mapInArrow(scan, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
