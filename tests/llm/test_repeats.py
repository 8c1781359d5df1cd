"""Long repeats against brute force, and the run-length index against a plain suffix sort."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fluxprint.llm import repeats, runindex
from fluxprint.llm.repeats import SPAN


def brute(docs):
    """{doc_id: (n_bytes, spans, kept)} by a table of all windows."""
    first = {}
    for i, raw in docs:
        for j in range(len(raw) - SPAN + 1):
            w = raw[j:j + SPAN]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, raw in docs:
        gone = [False] * len(raw)
        for j in range(len(raw) - SPAN + 1):
            if first[raw[j:j + SPAN]] < i:
                gone[j:j + SPAN] = [True] * SPAN
        spans, at = [], None
        for k, g in enumerate([*gone, False]):
            if g and at is None:
                at = k
            if not g and at is not None:
                spans.append((at, k))
                at = None
        out[i] = (len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé1 ") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(8, 40)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 5))]
        docs.append("".join(parts))
    docs += [docs[3], docs[3], "z" * 130, "z" * 120, passages[0][:49], passages[0][:50], "", "long " * 30_000]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_without_repeats_equals_brute_force(spark, frame, seed):
    rows = corpus(seed)
    got = repeats.without_repeats(frame(rows, "doc_id bigint, text string")).collect()
    want = brute([(i, t.encode()) for i, t in rows])
    assert {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got} == want


def test_null_ids_null_texts_and_repeated_rows(spark, frame):
    same = "the very same words in a row of more than fifty bytes, again and again"
    rows = [(1, same), (1, same), (None, same), (2, same), (3, None)]
    got = sorted(repeats.without_repeats(frame(rows, "doc_id bigint, text string")).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, len(r.spans), len(r.kept)) for r in got] == [(1, 0, len(same)), (1, 0, len(same)), (2, 1, 0), (3, 0, 0), (None, 0, len(same))]


def test_empty_table(spark, frame):
    assert repeats.without_repeats(frame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_run_index_streams_the_predecessors_of_a_suffix_sort(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 100, 76).astype(np.uint8)
    made = set()
    while len(made) < 40:
        lo = int(rng.integers(0, 20))
        piece = base[lo:lo + int(rng.integers(SPAN, 57))].copy()
        if rng.random() < 0.5:
            piece[int(rng.integers(0, len(piece)))] = 100
        made.add(piece.tobytes())
    pieces = sorted(made)
    text, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    index = runindex.build(text, sizes)
    assert len(index.sampled) < (index.left >= SPAN).sum() and len(index.heads) < len(index.owner)
    windows, before, length = runindex.matching(index)
    tails = [pieces[o][len(pieces[o]) - n:] for o, n in zip(index.owner, index.left)]
    ranked = sorted(windows, key=lambda i: (tails[i], i))
    for last, now in zip([None, *ranked], ranked):
        k = int(np.searchsorted(windows, now))
        if last is None:
            assert before[k] == -1 and length[k] == 0
        else:
            common = next((n for n, (x, y) in enumerate(zip(tails[last], tails[now])) if x != y), min(len(tails[last]), len(tails[now])))
            assert (before[k], length[k]) == (last, common)


def test_query_digests_its_operator(spark):
    from fluxprint.llm.queries import QUERIES

    rows = QUERIES["op4_run_length_repeats"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = brute(sorted(docs.items()))
    assert {r.doc_id: tuple(r) for r in rows} == {
        i: (i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, (n, spans, kept) in want.items()}


def crowd(n, seed=5):
    """Distinct phrases of one anchor: what precedes a common passage differs, some of it only in part."""
    rng = np.random.default_rng(seed)
    common = rng.integers(97, 123, 49, np.uint8)
    rows = {bytes(rng.integers(97, 99 if i % 2 else 123, rng.integers(1, 28), np.uint8)) + common.tobytes() for i in range(n)}
    rows = sorted(rows, key=lambda r: hash_of(r))
    sizes = np.array([len(r) for r in rows])
    return np.frombuffer(b"".join(rows), np.uint8), sizes, np.sort(rng.integers(0, n, len(rows)))


def hash_of(raw):
    return hashlib.md5(raw).digest()


def test_a_crowded_anchor_is_marked_as_by_one_index(monkeypatch):
    text, sizes, first = crowd(3000)
    want = runindex.repeated(text, sizes, first)
    assert (want > 0).sum() > 100
    key = np.zeros(len(sizes), np.uint32)
    for index, classes in ((1 << 10, 1 << 12), (64, 1 << 30), (1 << 30, 1 << 30)):
        monkeypatch.setattr(repeats, "INDEX_WINDOWS", index)
        monkeypatch.setattr(repeats, "CLASS_WINDOWS", classes, raising=False)
        assert (repeats._marks(key, first, sizes - SPAN + 1, text) == want).all()


def test_memory_of_a_crowded_anchor_follows_its_text():
    text, sizes, first = crowd(60_000)
    tracemalloc.start()
    repeats._marks(np.zeros(len(sizes), np.uint32), first, sizes - SPAN + 1, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text)


def test_ranges_are_gathered_without_an_index_of_all_their_bytes():
    data = np.arange(1 << 20, dtype=np.uint8)
    start, size = np.arange(0, 1 << 20, 40), np.full(1 << 20, 70)[:len(range(0, 1 << 20, 40))]
    start, size = start[:-2], size[:-2]
    tracemalloc.start()
    got = repeats._gather(data, start, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tobytes() == b"".join(data[a:a + 70].tobytes() for a in start) and peak < 10 * len(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_of_a_shard_and_crowded_anchors_equal_brute_force(spark, frame, seed, monkeypatch):
    monkeypatch.setattr(repeats, "PART_PHRASES", 8, raising=False)
    monkeypatch.setattr(repeats, "INDEX_WINDOWS", 16)
    monkeypatch.setattr(repeats, "CLASS_WINDOWS", 64, raising=False)
    rows = [(i, t) for i, t in corpus(seed) if len(t) < 10_000]
    docs = frame(rows, "doc_id bigint, text string").repartition(3)
    found = repeats.materialize(docs, "docs")
    shared = repeats.shared_anchors(repeats.anchors(found, 2), 2)
    sent = repeats.repeated_phrases(found, shared, 2, 3).collect()
    phrases = [pa.RecordBatch.from_pylist([r.asDict() for r in sorted(sent, key=lambda r: r.shard)], schema=pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("anchors", "hashes", "firsts", "windows", "texts")]]))]
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f))
    repeats.answered(spark.createDataFrame([], repeats.PHRASES), 2)
    told = {}
    for batch in run[0](iter(phrases)):
        n = len(whole := np.frombuffer(batch.column(1)[0].as_py(), np.uint64))
        raw = repeats.zstandard.decompress(batch.column(2)[0].as_py())
        told |= dict(zip(whole.tolist(), zip(np.frombuffer(raw, np.int64, n).tolist(), np.frombuffer(raw, np.uint32, offset=8 * n).tolist())))
    want = {}
    windows = {}
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        for j in range(len(data) - SPAN + 1):
            w = data[j:j + SPAN].tobytes()
            windows[w] = min(windows.get(w, i), i)
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        start, many, _, whole, _ = repeats.phrases(data, np.array([0, len(data)]))
        for s, m, h in zip(start, many, whole.tolist()):
            if h in told:
                bits = [windows[data[s + k:s + k + SPAN].tobytes()] for k in range(m)]
                want[h] = min(want.get(h, (i, None))[0], i), bits
    assert told.keys() == want.keys() and len(told) > 20
    for h, (least, marks) in told.items():
        assert least == want[h][0] and marks == sum(1 << k for k, w in enumerate(want[h][1]) if w < least)
