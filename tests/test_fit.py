"""Codebook fitting and decoders against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidforge.operators import decoder, fit, kmeans, quantize
from sidforge.sources import model as models

SCHEMA = "idx bigint, embedding array<float>"


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


def plain_lloyd(x, centres, steps):
    centres = centres.copy()
    for _ in range(steps):
        gap = np.square(x[:, None] - centres[None]).sum(axis=2)
        code = gap.argmin(axis=1)
        for c in range(len(centres)):
            if (code == c).any():
                centres[c] = x[code == c].mean(axis=0)
    return centres, np.square(x[:, None] - centres[None]).sum(axis=2).min(axis=1).sum()


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    x = np.float32(rng.standard_normal((400, 5)) + rng.integers(0, 4, (400, 1)) * 4)
    return np.concatenate([x, x[:150], np.repeat(x[:1], 200, axis=0)]).astype(float)


def test_restarts_share_passes_and_copies_weigh(spark, points):
    starts = np.stack([points[:6], points[10:16], np.full((6, 5), 1e6)])
    starts[2, 0] = points[0]
    found = kmeans.lloyd(kmeans.distinct_points(table(spark, points)), starts, 4, tolerance=0.0)
    for start, centres, cost in zip(starts, found.centres, found.costs):
        want, loss = plain_lloyd(points, start, 4)
        assert np.allclose(centres, want) and np.isclose(cost, loss)
    assert (found.centres[2, 1:] == 1e6).all()  # nobody chose them
    assert found.passes == 5


def test_one_restart_at_a_time_gives_the_same(spark, points, monkeypatch):
    rows = kmeans.distinct_points(table(spark, points))
    together = kmeans.fit_centres(rows, 4, 5, 3, 7)
    monkeypatch.setattr(quantize, "BROADCAST_BYTES", 100)
    apart = kmeans.fit_centres(rows, 4, 5, 3, 7)
    assert np.allclose(together.centres, apart.centres) and np.allclose(together.costs, apart.costs)


def test_fit_takes_the_cheapest_restart_and_settles(spark, points):
    book = fit.fit_codebook(table(spark, points), 4, restarts=3)
    words = quantize.fetch_levels(book)[0]
    assert words.shape == (4, 5)
    again, cost = plain_lloyd(points, words, 1)
    assert np.square(points[:, None] - words[None]).sum(axis=2).min(axis=1).sum() <= cost * 1.01
    rows = kmeans.distinct_points(table(spark, points))
    every = kmeans.fit_centres(rows, 4, 100, 3, 2024)
    assert np.allclose(words, every.centres[every.costs.argmin()])


def test_few_distinct_vectors_and_bad_starts(spark, points):
    same = table(spark, np.repeat(points[:2], 5, axis=0))
    words = quantize.fetch_levels(fit.fit_codebook(same, 5))[0]
    assert {tuple(w) for w in np.round(words, 5)} == {tuple(w) for w in np.round(points[:2], 5)}
    with pytest.raises(ValueError, match="samples"):
        fit.fit_codebook(same, 11)
    with pytest.raises(ValueError, match="first centres"):
        fit.fit_codebook(same, 5, start=fit.codebook_table(spark, [points[:3].tolist()]))


def test_balanced_steps_lower_the_loss_and_use_codes(spark, points):
    df = table(spark, points[:400])
    start = fit.codebook_table(spark, [points[:8].tolist(), (points[8:16] * 0.1).tolist()])
    moved = fit.fit_balanced(df, start, [0.05, 0.0], 3, batch_rows=100, iters=20)
    loss = [quantize.quant_loss(df, b).first().mean_loss for b in (start, moved)]
    assert loss[1] < loss[0]
    used = [quantize.assign_codes(df, b).select("code_0").distinct().count() for b in (start, moved)]
    assert used[1] >= used[0] and sorted(moved.groupBy("level").count().collect()) == [(0, 8), (1, 8)]


def test_decoder_is_least_squares(spark):
    rng = np.random.default_rng(3)
    book = [rng.standard_normal((6, 3)).tolist(), (rng.standard_normal((6, 3)) / 3).tolist()]
    codes = rng.integers(0, 6, (300, 2))
    sums = np.array(book[0])[codes[:, 0]] + np.array(book[1])[codes[:, 1]]
    x = sums @ rng.standard_normal((3, 7)) + rng.standard_normal(7) + rng.standard_normal((300, 7)) / 5
    x = np.float32(x).astype(float)
    rows = [(int(a), int(b), v.tolist()) for (a, b), v in zip(codes, x)] + [(None, 1, x[0].tolist())]
    coded = spark.createDataFrame(rows, "code_0 int, code_1 int, embedding array<float>")
    codebook = fit.codebook_table(spark, book)
    layers = decoder.fit_decoder(coded, codebook)
    want = np.linalg.lstsq(np.hstack([sums, np.ones((300, 1))]), x, rcond=None)[0]
    got = [(r.weights, r.bias) for r in layers.orderBy("unit").collect()]
    assert np.allclose([w for w, _ in got], want[:-1].T) and np.allclose([b for _, b in got], want[-1])
    back = decoder.decode_projected(coded, codebook, layers)
    assert back.where("reconstruction is null").count() == 1 and back.count() == 301


def test_quantizer_with_projection_needs_and_keeps_a_decoder(spark, folder, points):
    df = table(spark, points[:100])
    from sidforge.operators.project import fit_projection, mlp_project

    layers = fit_projection(df, 2)
    latent = mlp_project(df, layers, None, out="latent").select("idx", F.col("latent").alias("embedding"))
    model = models.Quantizer(fit.fit_codebook(latent, 8), layers, "none")
    with pytest.raises(ValueError, match="decoder"):
        model.reconstruct(model.assign(df))
    fitted = model.with_decoder(df)
    models.save_model(fitted, f"{folder}/m")
    again = models.load_model(spark, f"{folder}/m")
    assert abs(again.loss(df).first().recon - fitted.loss(df).first().recon) < 1e-12
    assert fitted.loss(df).first().recon < float(points[:100].var(axis=0).mean())
