"""Kneser-Ney: against a plain model, sums to one, separates labelled junk."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from fluxprint.llm import kneser

ORDER = 3


def plain(texts, order):
    """{gram bytes: probability} maker, by dictionaries."""
    pad = b"\0" * (order - 1)
    top = collections.Counter(g for t in texts for g in (bytes((pad + t)[i:i + order]) for i in range(len(t))))
    tables = {order: top}
    for m in range(order - 1, 0, -1):
        tables[m] = collections.Counter(g[1:] for g in tables[m + 1])
    cut = {}
    for m, t in tables.items():
        cut[m] = kneser.discounts(*(sum(1 for v in t.values() if v == k) for k in (1, 2, 3, 4)))

    def p(gram):
        m = len(gram)
        if not m:
            return 1 / 256
        t, d = tables[m], cut[m]
        mine = {g: n for g, n in t.items() if g[:-1] == gram[:-1]}
        low = p(gram[1:])
        if not mine:
            return low
        off = lambda n: d[min(n, 3) - 1]
        n = mine.get(gram, 0)
        return ((n - off(n) if n else 0) + sum(off(v) for v in mine.values()) * low) / sum(mine.values())

    return p


def test_likelihoods_equal_a_plain_model(spark, frame):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab bcdé\n") for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["", None]
    df = frame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("x"))
    from fluxprint.session import materialize

    df = materialize(df, "fixture")
    trusted = df.filter("doc_id < 15")
    got = {r.doc_id: r.nll for r in kneser.scored(df, trusted, ORDER).collect()}
    p = plain([t.encode() for t in texts[:15]], ORDER)
    for i, t in enumerate(texts):
        raw = b"\0" * (ORDER - 1) + (t or "").encode()
        want = -sum(math.log(p(raw[k:k + ORDER])) for k in range(len(raw) - ORDER + 1))
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))
    assert abs(sum(p(b"ab" + bytes([c])) for c in range(256)) - 1) < 1e-9


def test_folds_and_long_texts_equal_whole_counts(spark, frame, monkeypatch):
    """Small folds, keys sent on early and a text cut into pieces count and score as whole texts do."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (0, 3, 50, 2_000, 7, 900)] + [None]
    batches = lambda: iter([pa.RecordBatch.from_pydict({"t": pa.array(texts[:4])}), pa.RecordBatch.from_pydict({"t": pa.array(texts[4:])})])

    def total():
        out = collections.Counter()
        for keys, n in kneser.folded(batches(), 0, ORDER):
            assert (np.diff(keys) > 0).all()
            out.update(dict(zip(keys.tolist(), n.tolist())))
        return out

    whole = total()
    df = frame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("x"))
    scores = lambda: {r.doc_id: r.nll for r in kneser.scored(df, df.filter("doc_id < 4"), ORDER).collect()}
    before = scores()
    monkeypatch.setattr(kneser, "FOLD_BYTES", 64)
    monkeypatch.setattr(kneser, "MOST_KEYS", 20)
    assert total() == whole and sum(whole.values()) == sum(len((t or "").encode()) for t in texts)
    data = np.frombuffer(texts[3].encode(), np.uint8)
    assert (np.concatenate(list(kneser.pieces(data, np.array([0, len(data)]), ORDER))) == kneser.ngrams(data, np.array([0, len(data)]), ORDER)).all()
    assert all(abs(before[i] - n) < 1e-6 * max(1, abs(n)) for i, n in scores().items())


def test_separates_junk_and_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = kneser.judged(docs, labels)
    rate = {r[0]: r[1] for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("rejected").cast("int"))).collect()}
    assert got.count() == docs.count() and rate[1] < 0.02 and rate[0] > 0.85


def test_odd_tables(spark, frame):
    rows = [(1, "some plain text", "x"), (2, None, "x"), (3, "", None), (None, "plain text", None), (4, "zzz\0" * 100_000, "y"), (1, "some plain text", "x")]
    docs = frame(rows, "doc_id bigint, text string, lang string")
    labels = frame([(1, 1, 0), (2, 1, None), (None, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = kneser.judged(docs, labels).collect()
    assert len(got) == 6 and {r.doc_id for r in got if r.rejected} >= {2, 3} and not [r for r in got if r.doc_id == 1 and r.rejected]
    kept = kneser.clean(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1
    assert kneser.judged(frame([], "doc_id bigint, text string, lang string"), labels).count() == 0
    assert kneser.judged(docs, labels.limit(0)).filter("rejected and n_bytes > 0").count() == 0


def test_keeps_clean_text_of_a_rare_language_in_another_script(spark, frame):
    rng = random.Random(4)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    latin, greek = "etaoinshrdlu", "αβγδεζηθικλμνοπρστ"
    rows = [(i, words(latin, 60), "en") for i in range(80)] + [(100 + i, words(greek, 60), "el") for i in range(5)]
    rows += [(200, words(greek, 60), None), (300, "#$%&*|~^" * 40, "en"), (301, "", "el"), (302, None, None)]
    docs = frame(rows, "doc_id bigint, text string, lang string")
    labels = frame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in kneser.judged(docs, labels).collect()}
    assert {i for i in got if got[i].rejected and i >= 100} == {300, 301, 302}
    assert got[101].threshold is None and got[101].score is not None


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = kneser.Lookup(keys, np.arange(len(keys), dtype=np.float32))
    assert (table(keys[::-1]) == np.arange(len(keys))[::-1]).all()
