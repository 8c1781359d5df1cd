"""Vectors: links against brute force, and odd vectors."""

import numpy as np

from fluxprint.llm import itq


def rows(n=600, width=64, seed=1):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(width) for _ in range(n)]
    out += [out[k] + rng.standard_normal(width) * 0.28 for k in range(200)]
    out += [out[5] * 3 for _ in range(5)] + [out[7] + rng.standard_normal(width) * 0.02 for _ in range(60)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


def test_recall_and_no_false_link(spark, frame):
    data = rows()
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in itq.near_vectors(frame(data, "vec_id bigint, embedding array<double>")).collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.95 * true.sum()
    assert all(got[i].n_links <= true[i].sum() for i in got)
    assert all(got[i].kept == (got[i].component_id == i) and got[i].component_id <= i for i in got)


def test_unusable_vectors_link_with_nothing(spark, frame):
    one = [1.0, 2.0, 3.0]
    data = [(1, one), (2, one), (2, one), (3, [2.0, 4.0, 6.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0, None, 3.0]), (7, [float("nan"), 2.0, 3.0]), (8, []),
            (9, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (None, one), (11, [1e200, 2e200, 3e200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(frame(data, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 11: (3, 1), **{i: (0, i) for i in (4, 5, 6, 7, 8, 9, 10)}}


def test_empty_table(spark, frame):
    assert itq.near_vectors(frame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_codes_are_balanced():
    x = np.random.default_rng(2).standard_normal((2000, 64)) @ np.diag(np.linspace(1, 5, 64))
    mean, matrix = itq.learn(x)
    assert abs(((x - mean) @ matrix >= 0).mean(0) - 0.5).max() < 0.1
    assert np.linalg.matrix_rank(matrix) == 64
