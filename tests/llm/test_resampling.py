"""Bit-sliced resampling: the CRC kernels, the planes, and the whole draw against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxprint.llm import resampling as R

SCHEMA = "doc_id bigint, text string"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % R.BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def by_hand(docs, target):
    s, t = np.zeros(R.BUCKETS, int), np.zeros(R.BUCKETS, int)
    for _, text in docs:
        np.add.at(s, buckets(text), 1)
    for _, text in target:
        np.add.at(t, buckets(text), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (float(s.sum()) + 10000) / ((a + 1) * (float(t.sum()) + 10000)))) for a, b in zip(s, t)]
    out = {}
    for i, text in docs:
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(text))
        out[i] = [len(buckets(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, text in docs if len(words(text)) >= 20), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(able[:5 * len(able) // 100], 1):
        out[i][3] = rank
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "naïve", "Ärger", "x1", "9", "日本", "a-b", "don't", "é" * 40, "w" * 70] + [f"t{i}" for i in range(60)]
    return [(i * 3, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 60, 200])))) for i in range(n)]


def test_draw_equals_brute_force(spark, frame):
    docs, target = corpus(400), [(i, t) for i, t in corpus(9, seed=8)]
    docs += [(5000, "aa " * 400_000 + "zz"), (5001, "q" * 700_000 + " b c d")]
    df = R.resampled(frame(docs, SCHEMA), spark.createDataFrame(target, SCHEMA))
    assert df.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in df.collect()} == by_hand(docs, target)


def test_ranks_do_not_depend_on_partitions(spark, frame):
    docs, target = corpus(300, 5), spark.createDataFrame(corpus(4, 6), SCHEMA)
    a, b = (R.resampled(frame(d, SCHEMA, p), target).select("doc_id", "rank").collect() for d, p in ((docs, 1), (docs[::-1], 7)))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_nulls_repeated_rows_ties_and_empty_tables(spark, frame):
    long = " ".join(f"w{i}" for i in range(25))
    docs = [(None, long), (1, None), (2, "")] + [(7, long)] * 40
    got = R.resampled(frame(docs, SCHEMA), spark.createDataFrame([(1, "w1 w2")], SCHEMA)).collect()
    assert len(got) == 43 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert {(r.n_features, r.weight) for r in got if r.doc_id in (1, 2)} == {(0, 0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert R.resampled(empty, empty).count() == 0
    assert R.resampled(frame([(1, long)], SCHEMA), empty).select("n_features", "rank").collect() == [(72, None)]


def test_clashing_columns_are_left_behind(spark, frame):
    df = frame([(i, "a b c " * 10) for i in range(40)], SCHEMA).withColumns({c: F.lit("x") for c in ("weight", "rank", "range", "lead", "eligible", "n_words")})
    got = R.resampled(df, df.limit(1)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and {r.n_features for r in got} == {87}


@pytest.mark.parametrize("seed", range(3))
def test_planes_give_the_plain_sum(seed):
    rng = np.random.default_rng(seed)
    gain = rng.integers(-20_000, 20_000, R.BUCKETS)
    counts = rng.integers(0, [2, 300, 70_000][seed], (5, R.BUCKETS))
    bits = int(np.abs(gain).max()).bit_length() + 1
    assert (R.weighed(counts, R.planes(gain, bits)) == counts @ gain).all()
    assert (R.weighed(np.zeros((2, R.BUCKETS), np.int64), R.planes(gain, bits)) == 0).all()


def test_shifted_crc_joins_strings_of_any_length():
    rng = random.Random(2)
    parts = [(bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))), bytes(rng.randrange(256) for _ in range(n))) for n in (0, 1, 5, 63, 64, 65, 200, 5000)]
    a, b = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    got = R.shifted(a, np.array([len(p[1]) for p in parts])) ^ b
    assert got.tolist() == [zlib.crc32(x + y) for x, y in parts]


def test_pieces_of_a_long_text_count_each_run_once():
    rng = random.Random(4)
    text = " ".join(rng.choice(["aa", "b", "ccc" * 30, "dd"]) for _ in range(60_000)) + " " + "e" * 600_000 + "  f"
    got = [c for _, sym, at, known in R.pieces(pa.array(["x y", text, None, "z"])) for c in R.features(sym, at, known)[1] % R.BUCKETS]
    assert sorted(got) == sorted(buckets("x y") + buckets(text) + buckets("z"))
