"""Filter audit against a filter run of every order, odd texts, repeated rows and hot groups."""

import itertools
import random
import re

from pyspark.sql import functions as F

from fluxprint.llm import audit

SCHEMA = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"


def fails(letter, doc, docs):
    i, text, _ = doc
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)}[letter]


def by_running_the_filters(docs, labels):
    out = {}
    for part in {d[2] or "" for d in docs}:
        mine = [d for d in docs if (d[2] or "") == part]
        verdict = {(k, x): fails(x, d, docs) for k, d in enumerate(mine) for x in "ABCDE"}
        good = {k for k, d in enumerate(mine) if any(i == d[0] is not None and q == 1 for i, q, _ in labels)}
        toxic = {k for k, d in enumerate(mine) if any(i == d[0] is not None and t == 1 for i, _, t in labels)}
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(range(len(mine)))
            for step, x in enumerate(order, 1):
                gone = {k for k in left if verdict[k, x]}
                failing = {k for k in range(len(mine)) if verdict[k, x]}
                left -= gone
                share[x] += len(gone)
                only = sum(all(not verdict[k, y] for y in "ABCDE" if y != x) for k in failing)
                out[part, order, step] = [len(left), len(gone), len(failing - gone), only, len(gone & good), len(gone & toxic), x]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = share[row[6]] if isinstance(row[6], str) else row[6]
    return {k: tuple(v) for k, v in out.items()}


def report(df, labels):
    rows = audit.interactions(audit.combinations(df, labels)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["ab", "cd", "Ef", "gh#", "ü", "\x1cx\x85", "ij", "k%"] + [f"w{i}" for i in range(200)] * rng.randint(0, 1)) for _ in range(rng.choice([3, 150, 230, 400])))
             for _ in range(n // 2)] + [None, "", "\t\n ", "A" * 50]
    return [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(n)]


def test_equals_the_filters_run_in_every_order(spark, frame):
    docs = corpus() + [(None, "ab", "en"), (None, "ab", "en"), (5, "again", "de"), (5, "again", "de"), (6, "again", None)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 120, 2)] + [(4, None, 1), (None, 1, 1), (7, 0, 0), (7, 1, None)]
    got = report(frame(docs, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert got == by_running_the_filters(docs, labels)


def test_borders_of_the_filters():
    assert audit.own_failures(b"") == 1                                                     # no words: short, but not repetitive
    words = [b"w%d" % i for i in range(200)]
    assert audit.own_failures(b" ".join(words)) == 0
    assert audit.own_failures(b" ".join(words[:199])) == 1
    assert audit.own_failures(b" ".join(words[:100] * 2)) == 0 and audit.own_failures(b" ".join(words[:99] * 2 + [b"w0", b"w1"])) == 2
    assert audit.own_failures(b"AAA" + b"b" * 97) == 1 and audit.own_failures(b"AAA" + b"b" * 96) == 1 | 4
    assert audit.own_failures("AAA".encode() + "é".encode() * 97) == 1                      # code points, not bytes
    assert audit.own_failures(b"a|b") == 1 | 8
    assert audit.own_failures("A b".encode() * 100) & 2 and audit.own_failures("a ".encode() * 300) & 1   # only ASCII spaces part words


def test_pieces_tear_no_word():
    raw = b" ".join(b"x%d" % (i % 5000) for i in range(400_000)) + b"\n" + b"y" * 3_000_000
    held = list(audit.pieces(raw))
    assert b"".join(held) == raw and len(held) > 2
    assert sum(len(p.split()) for p in held) == 400_001
    assert audit.own_failures(raw) == 2


def test_a_third_of_all_rows_are_copies(spark, frame):
    docs = [(i, "same text" if i % 3 == 0 else f"text {i}", "en") for i in range(3000)]
    combos = audit.combinations(frame(docs, SCHEMA, 8), spark.createDataFrame([], LABELS))
    assert {r.bits: (r.n, r.good, r.toxic) for r in combos.collect()} == {1: (2001, 0, 0), 17: (999, 0, 0)}


def test_empty_tables_and_clashing_columns(spark, frame):
    assert report(frame([], SCHEMA), spark.createDataFrame([], LABELS)) == {}
    df = frame([(1, "a", "en")], SCHEMA).withColumns({c: F.lit(9) for c in ("bits", "part", "digest", "raw", "good", "quality", "toxic", "first_id", "step")})
    got = report(df, spark.createDataFrame([(1, 1, 0)], LABELS).withColumns({"good": F.lit(3), "lang": F.lit("x"), "text": F.lit("y")}))
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 1, 0, 120)
