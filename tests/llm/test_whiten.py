"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from sidforge.llm import queries, whiten

SCHEMA = "vec_id bigint, embedding array<float>"


def dense(rows):
    """Per row (vec_id, deviation, |whitened|), and explained shares."""
    sound = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in sound]
    fit = sorted({v for _, v in x})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    gaps = np.array([[n * a - s for a, s in zip(v, sums)] for v in fit], dtype=object)
    centred = (gaps / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    own = [[n * a - s for a, s in zip(v, sums)] for _, v in x]
    deviations = [sum(g * g for g in r) for r in own]
    projected = (np.array(own, dtype=object) / n).astype(float) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    return [i for i, _ in x], n, deviations, projected, values / values.sum(), vectors


def check(spark, rows, k, tol=1e-9):
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA), ["vec_id"]).collect()
    ids, n, deviations, projected, shares, _ = dense(rows)
    assert len(got) == len(ids) * k
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(zip(ids, deviations))
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    for j in range(k):
        own = {r.vec_id: r for r in got if r.component == j + 1}
        w = np.array([own[i].whitened for i in ids])
        sign = np.sign(w @ projected[:, j])
        assert np.abs(w * sign - projected[:, j]).max() < tol * np.abs(projected[:, j]).max()
        assert abs(own[ids[0]].explained / shares[j] - 1) < 1e-9


def test_random_vectors_with_bad_rows_and_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 40)) * np.geomspace(3, 0.2, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(300)]
    rows += [(2000, None), (2001, [math.nan, *x[1][1:].tolist()]), (2002, [*x[1][1:].tolist(), math.inf]), (2003, [None, *x[1][1:].tolist()])]
    check(spark, rows, 16)


def test_a_steep_spectrum_and_few_dimensions(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 20)) * np.geomspace(1e4, 0.5, 20)
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)], 16, 1e-6)
    check(spark, [(i, v[:3].tolist()) for i, v in enumerate(x)], 3)


@pytest.mark.parametrize("width", [1, 5, 64])
def test_any_width_spans_repeated_eigenvalues(spark, width):
    # +-e_i: every eigenvalue is the same, a single start vector would find one of them.
    d = 6
    rows = [(2 * i + s, [(1.0 - 2 * s) * (j == i) for j in range(d)]) for i in range(d) for s in (0, 1)]
    fitted = whiten.fit(spark.createDataFrame(rows, SCHEMA).select("embedding"), width=width)
    assert fitted.components.shape == (d, d)
    assert np.allclose(fitted.components.T @ fitted.components, np.eye(d), atol=1e-12)
    assert np.allclose(fitted.explained, 1 / d) and fitted.identity_error < 1e-10


def test_low_rank_empty_and_single(spark):
    rng = np.random.default_rng(7)
    flat = np.round(rng.standard_normal((200, 2)) * 4) / 2
    rows = [(i, [*v, *v, v[0] + v[1]]) for i, v in enumerate(flat.tolist())]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA), ["vec_id"]).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-8
    for some in ([], rows[:1], [(1, None)], [(1, [])]):
        assert whiten.whiten(spark.createDataFrame(some, SCHEMA), ["vec_id"]).count() == 0


def test_other_widths_huge_entries_and_clashing_names(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 4)))]
    extra = [(100, [1.0] * 5), (101, [3e38, 0.0, 0.0, 0.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + extra, SCHEMA).selectExpr("*", "1 as n", "2 as _row", "3 as component", "4 as x")
    got = whiten.whiten(df, ["vec_id", "_row", "x"])
    assert got.columns == ["vec_id", "_row", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    seen = got.collect()
    assert {r.vec_id for r in seen} == {*range(50), 101, None}
    assert {r.deviation for r in seen if r.vec_id == 101} == {None}


def test_query_matches_dense(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op13_whitening"](spark, sf_dir).collect()
    ids, n, deviations, projected, shares, _ = dense(rows)
    assert len(got) == 16 * len(ids)
    for j in range(16):
        own = {r.vec_id: r.whitened for r in got if r.component == j + 1}
        w = np.array([own[i] for i in ids])
        assert np.abs(w * np.sign(w @ projected[:, j]) - projected[:, j]).max() < 1e-7
