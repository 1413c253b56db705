"""Assignment, decoding, losses, fitting and model tables against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidforge.operators import fit, kernels, project, quantize
from sidforge.sources import model as models


def make(spark, seed=0, n=300, dim=6, sizes=(7, 5, 4)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    books = [rng.normal(size=(k, dim)) / (level + 1) for level, k in enumerate(sizes)]
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, embedding array<float>"
    )
    return x.astype(np.float64), books, df, fit.codebook_table(spark, books)


def by_hand(x, books):
    rest, codes, errors = x, [], []
    for book in books:
        code = ((rest[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        rest = rest - book[code]
        codes.append(code)
        errors.append((rest**2).sum(axis=1))
    return np.stack(codes, 1), rest, np.stack(errors, 1)


def sorted_codes(df, levels=3):
    return np.array([[r[f"code_{i}"] for i in range(levels)] for r in df.orderBy("idx").collect()])


@pytest.mark.parametrize("limit", [quantize.BROADCAST_BYTES, 3 * 6 * 8, 1])
def test_codes_do_not_depend_on_the_broadcast_limit(spark, limit):
    x, books, df, table = make(spark)
    codes, rest, errors = by_hand(x, books)
    found = quantize.assign_codes(
        df, table, keep=["idx", "embedding"], errors=True, residual=True, limit=limit
    )
    assert found.columns == ["idx", "embedding", "code_0", "code_1", "code_2", "errors", "residual"]
    rows = found.orderBy("idx").collect()
    assert (np.array([r[2:5] for r in rows]) == codes).all()
    assert np.allclose([r.errors for r in rows], errors)
    assert np.allclose([r.residual for r in rows], rest)


def test_lowest_code_wins_a_tie(spark):
    word = [0.1] * 5
    table = fit.codebook_table(spark, [[[9.0] * 5, word, [0.3] * 5, word, word]])
    df = spark.createDataFrame([(i, [i / 100.0] * 5) for i in range(20)], "idx int, embedding array<float>")
    for limit in (quantize.BROADCAST_BYTES, 80):
        assert {r.code for r in quantize.nearest_code(df, table, limit=limit).collect()} == {1}


def test_distances_and_nearest_agree(spark):
    x, books, df, table = make(spark, 1)
    rows = quantize.codebook_distances(df, table, 1).orderBy("idx").collect()
    wanted = ((x[:, None, :] - books[1][None]) ** 2).sum(axis=2)
    assert np.allclose([r.distances for r in rows], wanted)


def test_decode_plus_residual_is_the_vector(spark):
    x, books, df, table = make(spark, 2)
    coded = quantize.assign_codes(df, table, keep=["idx"], residual=True)
    rows = quantize.decode(coded, table).orderBy("idx").collect()
    assert np.allclose([np.add(r.reconstruction, r.residual) for r in rows], x)


def test_losses(spark):
    x, books, df, table = make(spark, 3)
    _, rest, errors = by_hand(x, books)
    mse = errors.mean(axis=0) / x.shape[1]
    rows = quantize.quant_loss(df, table, beta=0.5).orderBy("level").collect()
    assert np.allclose([r.mse for r in rows], mse)
    assert np.allclose([r.loss for r in rows], 1.5 * mse)
    assert np.allclose([r.mean_loss for r in rows], (1.5 * mse).mean())
    coded = quantize.decode(quantize.assign_codes(df, table, keep=["embedding"]), table)
    l1 = quantize.recon_loss(coded, "embedding", "reconstruction", "l1", 0.25, 2.0).first()
    assert l1.recon == pytest.approx(np.abs(rest).mean()) and l1.total == pytest.approx(l1.recon + 0.5)
    with pytest.raises(ValueError, match="unknown loss"):
        quantize.recon_loss(coded, "embedding", "reconstruction", "huber")


def test_lloyd_step_keeps_an_empty_codeword(spark):
    table = fit.codebook_table(spark, [[[0.0, 0.0], [10.0, 0.0], [99.0, 99.0]]])
    df = spark.createDataFrame(
        [([1.0, 0.0],), ([3.0, 0.0],), ([9.0, 2.0],)], "embedding array<float>"
    )
    moved = quantize.lloyd_step(df, table).orderBy("code").collect()
    assert [r.centroid for r in moved] == [[2.0, 0.0], [9.0, 2.0], [99.0, 99.0]]


def test_codebook_with_a_gap_is_refused(spark):
    table = fit.codebook_table(spark, [[[0.0], [1.0], [2.0]]]).where("code <> 1")
    with pytest.raises(ValueError, match="not 0..K-1"):
        quantize.fetch_levels(table)


@pytest.mark.parametrize("name", ["relu", "leakyrelu", "tanh", "Sigmoid", "none", None])
def test_layers(spark, name):
    x, _, df, _ = make(spark, 4)
    rng = np.random.default_rng(5)
    shapes = [(4, 6), (3, 4), (2, 3)]
    stack = [(rng.normal(size=s), rng.normal(size=s[0])) for s in shapes]
    rows = [
        (layer, unit, w[unit].tolist(), float(b[unit]))
        for layer, (w, b) in enumerate(stack) for unit in range(len(b))
    ]
    table = spark.createDataFrame(rows, project.LAYER_SCHEMA)
    y = x
    for depth, (w, b) in enumerate(stack):
        y = y @ w.T + b
        if depth < 2:
            y = kernels.activate(name, y)
    found = project.mlp_project(df, table, name).orderBy("idx").collect()
    assert np.allclose([r.latent for r in found], y)


def test_unknown_activation(spark):
    _, _, df, _ = make(spark)
    with pytest.raises(ValueError, match="unknown activation"):
        project.mlp_project(df, spark.createDataFrame([], project.LAYER_SCHEMA), "swish")


def test_batch_norm_folds_into_the_layer(spark):
    layers = spark.createDataFrame([(0, 0, [1.0, 2.0], 0.5), (0, 1, [3.0, 4.0], 1.0)], project.LAYER_SCHEMA)
    norms = spark.createDataFrame(
        [(0, 0, 2.0, 4.0, 3.0, 7.0)],
        "layer int, unit int, mean double, variance double, gamma double, beta double",
    )
    folded = {r.unit: r for r in project.fold_batch_norm(layers, norms).collect()}
    scale = 3.0 / np.sqrt(4.0 + 1e-5)
    assert np.allclose(folded[0].weights, [scale, 2 * scale])
    assert folded[0].bias == pytest.approx((0.5 - 2.0) * scale + 7.0)
    assert tuple(folded[1])[2:] == ([3.0, 4.0], 1.0)


def test_projection_is_principal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)) * [5.0, 3.0, 1.0, 0.5, 0.1] + 2.0
    df = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    layers = project.fit_projection(df, 3)
    w = np.array([r.weights for r in layers.orderBy("unit").collect()])
    assert np.allclose(w @ w.T, np.eye(3), atol=1e-9)
    shares = [r.share for r in project.explained_variance(df, layers).orderBy("component").collect()]
    assert shares == sorted(shares, reverse=True) and sum(shares) > 0.98
    latent = project.mlp_project(df, layers, None).select(F.col("latent")[0].alias("y"))
    assert abs(latent.agg(F.avg("y")).first()[0]) < 1e-9


def test_kmeans_pads_and_refuses(spark):
    df = spark.createDataFrame([([0.0, 0.0],)] * 5 + [([1.0, 1.0],)] * 5, "embedding array<double>")
    book = fit.fit_codebook(df, 4, 10)
    assert [r.code for r in book.orderBy("code").collect()] == [0, 1, 2, 3]
    assert {tuple(r.centroid) for r in book.collect()} == {(0.0, 0.0), (1.0, 1.0)}
    with pytest.raises(ValueError, match="cannot fill"):
        fit.fit_codebook(df, 11)


def test_residual_fit_lowers_the_error(spark):
    _, _, df, _ = make(spark, 6, n=500)
    book = fit.fit_rq(df, [8, 8, 8], sample_n=0, iters=15, restarts=1)
    rows = quantize.quant_loss(df, book).orderBy("level").collect()
    assert [r.mse for r in rows] == sorted((r.mse for r in rows), reverse=True)
    assert book.groupBy("level").count().orderBy("level").collect() == [(0, 8), (1, 8), (2, 8)]


def test_uniform_codebook_range_and_repeat(spark):
    book = fit.uniform_codebook(spark, 8, 5, seed=3)
    words = {r.code: r.centroid for r in book.collect()}
    flat = np.array([words[c] for c in range(8)])
    assert flat.shape == (8, 5) and (np.abs(flat) <= 1 / 8).all() and flat.std() > 0.04
    assert {r.code: r.centroid for r in fit.uniform_codebook(spark, 8, 5, seed=3).collect()} == words
    assert {r.code: r.centroid for r in fit.uniform_codebook(spark, 8, 5, seed=4).collect()} != words


def test_reloaded_model_gives_the_same_codes(spark, folder):
    x, books, df, table = make(spark, 7, dim=6)
    layers = spark.createDataFrame(
        [(0, u, np.eye(6)[u].tolist(), 0.25) for u in range(6)], project.LAYER_SCHEMA
    )
    for name, model in {
        "plain": models.Quantizer(table), "projected": models.Quantizer(table, layers, "tanh"),
    }.items():
        models.save_model(model, f"{folder}/{name}")
        again = models.load_model(spark, f"{folder}/{name}")
        assert again.activation == model.activation and (again.layers is None) == (model.layers is None)
        assert (sorted_codes(again.assign(df)) == sorted_codes(model.assign(df))).all()
    shifted = by_hand(x + 0.25, books)[0]
    assert (sorted_codes(models.load_model(spark, f"{folder}/projected").assign(df)) == shifted).all()


def test_decode_loses_no_row(spark):
    book = fit.codebook_table(spark, [[[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.5]]])
    rows = [(1, 0, 0, 7), (2, 1, 0, 3), (3, None, 0, 0)]
    ranked = spark.createDataFrame(rows, "idx bigint, code_0 int, code_1 int, code_2 int")
    found = {r.idx: r.reconstruction for r in quantize.decode(ranked, book).collect()}
    assert found == {1: [1.5, 0.5], 2: [0.5, 1.5], 3: None}
    with pytest.raises(Exception, match="code_0 outside the codebook: 5"):
        quantize.decode(spark.createDataFrame([(1, 5, 0)], "idx bigint, code_0 int, code_1 int"), book).collect()


LIMITS = [quantize.BROADCAST_BYTES, 200]


@pytest.mark.parametrize("limit", LIMITS)
def test_every_lookup_ignores_the_broadcast_limit(spark, monkeypatch, limit):
    x, books, df, table = make(spark, 8, n=60)
    repeated = [np.vstack([b, b[:2]]) for b in books]
    table = fit.codebook_table(spark, repeated)
    monkeypatch.setattr(quantize, "BROADCAST_BYTES", limit)
    codes, rest, _ = by_hand(x, books)
    assert (sorted_codes(quantize.assign_codes(df, table)) == codes).all()
    wide = quantize.codebook_distances(df, table, 0).orderBy("idx").collect()
    assert np.allclose([r.distances for r in wide], ((x[:, None] - repeated[0][None]) ** 2).sum(axis=2))
    near = quantize.nearest_code(df, table).orderBy("idx").collect()
    assert [r.code for r in near] == codes[:, 0].tolist()
    coded = quantize.assign_codes(df, table).withColumn("code_3", F.lit(5))
    back = quantize.decode(coded, table)
    assert back.columns == [*coded.columns, "reconstruction"]
    assert np.allclose([r.reconstruction for r in back.orderBy("idx").collect()], x - rest)
    hole = quantize.decode(coded.withColumn("code_1", F.expr("if(idx = 3, null, code_1)")), table)
    assert [r.idx for r in hole.where("reconstruction is null").collect()] == [3]
    with pytest.raises(Exception, match="outside the codebook"):
        quantize.decode(coded.withColumn("code_1", F.lit(77)), table).collect()


@pytest.mark.parametrize("limit", LIMITS)
def test_projection_ignores_the_broadcast_limit(spark, monkeypatch, limit):
    x, _, df, _ = make(spark, 9, n=40)
    rng = np.random.default_rng(1)
    stack = [(rng.normal(size=(5, 6)), rng.normal(size=5)), (rng.normal(size=(3, 5)), rng.normal(size=3))]
    rows = [
        (layer, unit, w[unit].tolist(), float(b[unit]))
        for layer, (w, b) in enumerate(stack) for unit in range(len(b))
    ]
    layers = spark.createDataFrame(rows, project.LAYER_SCHEMA)
    monkeypatch.setattr(quantize, "BROADCAST_BYTES", limit)
    found = project.mlp_project(df, layers, "relu").orderBy("idx").collect()
    wanted = np.maximum(x @ stack[0][0].T + stack[0][1], 0) @ stack[1][0].T + stack[1][1]
    assert np.allclose([r.latent for r in found], wanted)


@pytest.mark.parametrize("limit", LIMITS)
def test_broken_elements_count_as_zero(spark, monkeypatch, limit):
    monkeypatch.setattr(quantize, "BROADCAST_BYTES", limit)
    table = fit.codebook_table(spark, [[[9.0, 0.0], [0.0, 9.0]], [[0.0, 0.0], [0.0, 1.0]]])
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(0, [nan, 9.0]), (1, [inf, 9.0]), (2, [None, 9.0]), (3, [9.0, -inf]), (4, [0.0, 10.0])],
        "idx bigint, embedding array<float>",
    )
    found = quantize.assign_codes(df, table, residual=True).orderBy("idx").collect()
    assert [(r.code_0, r.code_1) for r in found] == [(1, 0), (1, 0), (1, 0), (0, 0), (1, 1)]
    assert all(np.isfinite(r.residual).all() for r in found)
    for bad in (None, [1.0]):
        broken = spark.createDataFrame([(0, [1.0, 1.0]), (1, bad)], df.schema)
        with pytest.raises(Exception, match="null vectors|ragged|expected 2"):
            quantize.assign_codes(broken.coalesce(1), table).collect()
        with pytest.raises(Exception, match="null vectors|ragged"):
            fit.fit_rq(broken, [1], iters=1, restarts=1)


@pytest.mark.parametrize("limit", LIMITS)
def test_stream_and_batch_agree(spark, monkeypatch, folder, limit):
    from sidforge.streaming.assign import stream_assign

    x, _, df, table = make(spark, 10, n=50)
    dirty = df.withColumn("embedding", F.expr("transform(embedding, (v, i) -> if((idx + i) % 7 = 0, float('nan'), v))"))
    dirty.repartition(4).write.parquet(f"{folder}/in")
    monkeypatch.setattr(quantize, "BROADCAST_BYTES", limit)
    model = models.Quantizer(table)
    streamed = stream_assign(
        spark, f"{folder}/in", f"{folder}/out", model, 6, f"{folder}/state", files_per_trigger=2
    )
    assert streamed.columns == ["idx", "code_0", "code_1", "code_2"]
    assert sorted(streamed.collect()) == sorted(model.assign(dirty).collect())
