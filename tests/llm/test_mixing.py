"""Mixing: posteriors learn the labels, rates meet the targets and equal a plain descent."""

import numpy as np
from pyspark.sql import functions as F

from fluxprint.llm import mixing

SF = "/root/testdata/sf0.01"


def test_expected_tokens_meet_the_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.rates(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.rate <= 1 and r.copies in (0, 1) for r in rows)
    a = np.array([r.tokens * np.array(r.posterior) for r in rows])
    rate = np.array([r.rate for r in rows])
    domains, _ = mixing.fit(docs, labels)
    goal = mixing.goals(domains, a.sum(0), mixing.TARGETS, 1.0)
    assert np.abs(rate @ a - goal).max() < 0.02 * goal.max()
    assert abs(np.mean([r.copies for r in rows]) - rate.mean()) < 0.05
    truth = {r.doc_id: f"q{r.quality}t{r.toxic}" for r in labels.collect()}
    hits = [domains[int(np.argmax(r.posterior))] == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert np.mean(hits) > 0.9


def test_descent_finds_the_least_squares_rates(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(1, 50, 400)
    table = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id bigint, tokens bigint, posterior array<double>")
    a = tokens[:, None] * p
    have, gram = a.sum(0), a.T @ a
    goal = np.clip(p[:, 0] + rng.normal(0, 0.3, 400), 0, 1) @ a  # rates that reach it exist
    rate = mixing._rates(a, mixing.descend(table, have, gram, goal, 1.0), 1.0)
    assert np.abs(rate @ a - goal).max() < 1e-3 * goal.max() and rate.min() >= 0 and rate.max() <= 1


def test_odd_tables(spark, frame):
    docs = frame([(1, "good fine text here"), (2, "bad %%% awful ### text"), (3, None), (4, ""), (None, "good"), (5, "word " * 100_000), (5, "again")], "doc_id bigint, text string")
    labels = frame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = mixing.rates(docs, labels).collect()
    assert len(got) == 7 and {r.doc_id: r.rate for r in got}[4] == 1.0
    none = mixing.rates(docs, frame([], "doc_id bigint, quality int, toxic int"))
    assert none.agg(F.min("rate"), F.max("rate"), F.min("copies")).first() == (1.0, 1.0, 1)
    assert mixing.rates(frame([], "doc_id bigint, text string"), labels).count() == 0
    kept = mixing.mix(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1
