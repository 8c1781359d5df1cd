"""DartMinHash: signatures estimate similarity, classes equal an exact join."""

import collections
import itertools
import random
import re

import numpy as np

from fluxprint.llm import blocks, common, darts


def bag(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    count = collections.Counter(tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))) if words else {}
    return {(k, layer) for k, v in count.items() for layer in range(v)}


def exact(rows):
    bags = {i: bag(t) for i, t in rows}
    at = {i: i for i in bags}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        common = len(bags[a] & bags[b])
        if common and common >= 0.8 * (len(bags[a]) + len(bags[b]) - common):
            x, y = root(a), root(b)
            at[max(x, y)] = min(x, y)
    return {i: root(i) for i in bags}


def corpus(groups, copies, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, i = [], 0
    for g in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 300))]
        for c in range(copies if g == 0 else rng.randint(1, 4)):
            edited = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60)) if c else 0):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((i, " ".join(edited)))
            i += 1
    return rows


def test_classes_equal_exact_join_with_a_large_group(spark, frame):
    rows = corpus(60, 120) + [(1000, "one two"), (1001, "One, two!"), (1002, "two one"), (1003, ""), (1004, None), (1005, ""), (1006, "long word " * 20_000)]
    got = {r.doc_id: (r.class_id, r.kept) for r in darts.classes(frame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (c, i == c) for i, c in {**exact(rows), 1003: 1003, 1004: 1004, 1005: 1005}.items()}


def variants(n, kept, units=60, seed=9):
    """Variants of one text of so many units of ten words that each have words of their own in place of some units."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = set(rng.sample(range(units), round(units * (1 - kept))))
        rows.append((i, " ".join(f"x{i}y{k}z{w}" if k in own else f"t{k}z{w}" for k in range(units) for w in range(10))))
    return rows


def test_caps_only_save_work(spark, frame, monkeypatch):
    for name, value in (("SMALL", 2), ("CENTRES", 1), ("FOLLOWING", 1), ("BLOCK", 16)):
        monkeypatch.setattr(darts, name, value, raising=False)
    paired, sizes = darts.all_pairs, []

    def seen(rows):
        sizes.append(rows.groupBy("band").count().agg({"count": "max"}).first()[0] or 0)
        return paired(rows)

    monkeypatch.setattr(darts, "all_pairs", seen)
    rows = variants(100, 0.95)
    got = {r.doc_id: r.class_id for r in darts.classes(frame(rows, "doc_id bigint, text string")).collect()}
    assert got == exact(rows)
    assert max(sizes) <= 2, sizes


def test_components_in_one_task_and_dealt_out(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    few = {tuple(r) for r in common.components(table).collect()}
    monkeypatch.setattr(common, "FEW_LINKS", 0)
    assert few == {tuple(r) for r in common.components(table).collect()}
    assert {c for n, c in few if n <= 40} == {0} and {c for n, c in few if 100 <= n < 140} == {100} and len(few) == len({n for n, _ in few})


def test_null_ids_repeated_rows_and_empty_table(spark, frame):
    text = "a b c d e f g"
    rows = [(2, text), (2, text), (None, text), (5, text), (5, "quite another text of some six words")]
    got = sorted(tuple(r) for r in darts.classes(frame(rows, "doc_id bigint, text string")).collect())
    assert got == [(2, 2, True), (5, 2, False)]
    assert darts.classes(frame([], "doc_id bigint, text string")).count() == 0
    kept = darts.clean(frame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 2), (True, None)]
    assert kept.columns == ["doc_id", "text", "block", "shard", "score", "kind", "n"]


def test_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        n = 400
        a = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64))
        common = int(2 * n * share / (1 + share))
        b = np.concatenate((a[:common], rng.integers(0, 1 << 62, n - common).astype(np.uint64)))
        sig = darts.signatures(np.repeat([0, 1], n), blocks.mix(np.concatenate((a, b))), 2)
        assert abs((sig[0] == sig[1]).mean() - common / (2 * n - common)) < 0.15


def test_signature_is_the_same_at_any_reach(monkeypatch):
    element = blocks.mix(np.arange(50, dtype=np.uint64))
    one = darts.signatures(np.zeros(50, np.int64), element, 1)
    monkeypatch.setattr(darts, "DARTS", darts.DARTS / 8)
    assert (darts.signatures(np.zeros(50, np.int64), element, 1) == one).all()
