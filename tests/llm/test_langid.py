"""Language identification: held-out accuracy, odd texts, pieces of long texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from fluxprint.llm import langid

SCHEMA = "doc_id bigint, text string, lang string"


def test_accuracy_on_held_out_documents(spark):
    from fluxprint.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    hit, n, lo, hi = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 100 and hit > 0.97 and 0 <= lo <= hi <= 1


def test_odd_texts(spark, frame):
    rows = [(1, "aaa aab aba", "x"), (2, "bbb bba bab", "y"), (3, None, "x"), (4, "", "y"), (5, "12 !?", "x"), (6, "aab", None), (7, "bba " * 200_000, None), (None, "aab", None)]
    df = frame(rows, SCHEMA)
    model = langid.fit(df)
    out = langid.predict(df, model)
    got = {r["doc_id"]: (r["lang_pred"], 0 <= r["score"] <= 1) for r in out.collect()}
    assert got == {1: ("x", True), 2: ("y", True), 3: ("und", True), 4: ("und", True), 5: ("und", True), 6: ("x", True), 7: ("y", True), None: ("x", True)}
    assert out.columns == ["doc_id", "text", "lang", "block", "shard", "kind", "n", "lang_pred", "score"]


def test_nothing_learned_and_empty_table(spark, frame):
    df = frame([(1, "abc", None)], SCHEMA)
    assert langid.predict(df, langid.fit(df)).select("lang_pred", "score").first() == ("und", 0.0)
    assert langid.predict(frame([], SCHEMA), langid.fit(df)).count() == 0


def test_prediction_equals_brute_force(spark, frame):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcé" if i % 2 else "bcdß") for _ in range(5)) for _ in range(rng.randint(1, 9))), "p" if i % 2 else "q") for i in range(40)]
    df = frame(rows, SCHEMA)
    names, logs = langid.fit(df)
    count = np.ones((2, langid.BUCKETS))

    def ids(text):
        symbols, _ = langid.letters([text])
        return [g for order in langid.ORDERS for g, s in zip(langid.grams(symbols, order, langid.BUCKETS), symbols) if s]

    for _, text, lang in rows:
        for g in ids(text):
            count[names.index(lang), g] += 1
    want = np.log(count / count.sum(1, keepdims=True)).T
    assert np.abs(want - logs).max() < 1e-4
    for r in langid.predict(df, (names, logs)).collect():
        total = want[ids(r["text"])].sum(0)
        assert r["lang_pred"] == names[total.argmax()] and abs(r["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-3


def test_pieces_cover_all_text():
    texts = ["ab" * 300_000, "", None, "c" * 10]
    got = {}
    for rows, held in langid.pieces(texts):
        assert sum(len(h) for h in held) <= langid.SLICE_CHARS + max(len(h) for h in held)
        for i, h in zip(rows, held):
            got[i] = got.get(i, "") + h
    assert got == {0: texts[0], 1: "", 2: "", 3: texts[3]}
