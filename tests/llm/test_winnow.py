"""Winnowing: the choice against its definition, the match guarantee, and neighbours against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxprint.llm import winnow

SCHEMA = "doc_id bigint, text string"


def plain(raw, k=winnow.GRAM, window=winnow.WINDOW):
    """Window by window: the smallest hash, the rightmost of equal ones."""
    if not raw:
        return []
    k = min(k, len(raw))
    hashes = [int(winnow.grams(np.frombuffer(raw[i:i + k], np.uint8), k)[0]) for i in range(len(raw) - k + 1)]
    chosen = set()
    for lo in range(max(1, len(hashes) - window + 1)):
        held = hashes[lo:lo + window]
        chosen.add(lo + max(j for j, h in enumerate(held) if h == min(held)))
    return [(hashes[p] << 32) | p for p in sorted(chosen)]


@pytest.mark.parametrize("seed", range(4))
def test_choice_equals_the_definition(seed):
    rng = random.Random(seed)
    for n in (0, 1, 5, 19, 20, 21, 63, 64, 65, 300, 1500):
        raw = bytes(rng.choice(b"ab") if seed % 2 else rng.randrange(256) for _ in range(n))
        assert winnow.fingerprint(np.frombuffer(raw, np.uint8)).tolist() == plain(raw)
    same = b"x" * 500                                             # equal hashes everywhere: the rightmost of each window
    assert winnow.fingerprint(np.frombuffer(same, np.uint8)).tolist() == plain(same)


def test_long_texts_are_chosen_in_pieces(monkeypatch):
    raw = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    whole = winnow.fingerprint(raw)
    monkeypatch.setattr(winnow, "SLICE", 97)
    assert (winnow.fingerprint(raw) == whole).all()


def test_a_common_passage_is_always_seen():
    rng = random.Random(6)
    least = winnow.GRAM + winnow.WINDOW - 1
    for _ in range(200):
        common = rng.randbytes(least)
        a, b = (rng.randbytes(rng.randint(0, 200)) + common + rng.randbytes(rng.randint(0, 200)) for _ in range(2))
        x, y = (winnow.fingerprint(np.frombuffer(t, np.uint8)) for t in (a, b))
        shared = set((x >> np.uint64(32)).tolist()) & set((y >> np.uint64(32)).tolist())
        at = [int(m) & 0xFFFFFFFF for m in x.tolist() if m >> 32 in shared]
        assert shared and any(a[p:p + winnow.GRAM] in common for p in at)


def by_hand(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        form = text[:n - n // 2] + following[:n // 2]
        marks = [plain(t.encode()) for t in (text, form, following)]
        sets = [{m >> 32 for m in ms} for ms in marks]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out[i] = (n, hashlib.sha256(form.encode()).hexdigest(), marks[0], marks[1], *near)
    return out


def unsigned(marks):
    return [m & 0xFFFFFFFFFFFFFFFF for m in marks]


def corpus(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abcdé日 😀") for _ in range(rng.choice([0, 1, 2, 7, 40, 300]))) for _ in range(n)]
    return [(i * 7 - 50, rng.choice(texts + [None])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 200])
def test_neighbours_equal_brute_force(spark, frame, n):
    docs = corpus(n) if n > 3 else [(i, f"text number {i} " * 20) for i in range(n)]
    for parts in (1, 5):
        got = winnow.neighbours(frame(docs, SCHEMA, parts)).collect()
        assert len(got) == n
        assert {r.doc_id: (r.n_chars, r.edited_sha256, unsigned(r.marks), unsigned(r.edited_marks), r.near_edited, r.near_next) for r in got} == by_hand(docs)


def test_digest_is_the_marks_in_hexadecimal(spark):
    marks = [(0x00000ABC << 32) | 5, (0xFFFFFFFF << 32) | 0x1234]
    raw = np.array(marks, np.uint64)
    df = spark.createDataFrame([(raw.view(np.int64).tolist(),), ([],)], "m array<bigint>")
    assert [r[0] for r in df.select(winnow.digests(F.col("m"))).collect()] == [winnow.digest(raw), ""] == ["00000abc00000005ffffffff00001234", ""]


def test_nulls_repeated_rows_empty_tables_and_clashing_columns(spark, frame):
    docs = [(None, "n"), (None, "m"), (3, None), (3, None), (4, "x" * 900_000), (3, "b")] + [(9, "same")] * 30
    df = frame(docs, SCHEMA).withColumns({c: F.lit("y") for c in ("slice", "extra", "raw", "marks", "_key", "_slice")})
    got = winnow.neighbours(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in docs)
    forms = {r.doc_id: r.edited_sha256 for r in got if r.doc_id in (4,)}
    assert forms == {4: hashlib.sha256(b"x" * 450_000).hexdigest()}            # the next text, of id 3 and null, is empty
    assert winnow.neighbours(frame([], SCHEMA)).count() == 0


def test_equal_texts_have_equal_fingerprints_and_edits_stay_near(spark):
    from fluxprint.llm.queries import QUERIES

    rows = QUERIES["op13_winnowing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    seen = {}
    for r in rows:
        assert seen.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    far = [r for r in rows if len(texts[r.doc_id]) > 300]
    assert np.mean([r.near_edited for r in far]) > 0.3 > 0.1 > np.mean([r.near_next for r in far])
