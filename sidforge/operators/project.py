"""Dense layers applied to vectors, and the projection fitted by PCA.

A projection is a table ``(layer int, unit int, weights array<double>, bias double)``:
one row per output unit. It is a model parameter, checked like a codebook.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.functions.vectors import sanitize
from sidforge.operators import kernels as k
from sidforge.operators import quantize
from sidforge.operators.quantize import _arrow_map, _column, _double_list
from sidforge.session import materialize
from sidforge.sources.vectors import valid_shape

LAYER_SCHEMA = "layer int, unit int, weights array<double>, bias double"
# Added to the variance in batch normalisation.
NORM_EPS = 1e-5


def fetch_layers(layers: DataFrame, limit: int | None = None) -> list[tuple] | None:
    """``(weights, bias)`` per layer, or ``None`` if they exceed ``limit`` bytes."""
    size = layers.agg(F.sum(F.size("weights") * F.lit(8))).first()[0] or 0
    if size > (quantize.BROADCAST_BYTES if limit is None else limit):
        return None
    grouped: dict[int, list] = {}
    for row in layers.orderBy("layer", "unit").collect():
        grouped.setdefault(row.layer, []).append(row)
    return [
        (np.array([r.weights for r in rows]), np.array([r.bias for r in rows]))
        for _, rows in sorted(grouped.items())
    ]


def fold_batch_norm(layers: DataFrame, norms: DataFrame) -> DataFrame:
    """Merge the fixed affine map of batch normalisation into the layers before it.

    ``norms`` holds ``(layer, unit, mean, variance, gamma, beta)``; units without
    a row stay as they are.
    """
    joined = layers.join(norms, ["layer", "unit"], "left")
    scale = F.coalesce(F.col("gamma") / F.sqrt(F.col("variance") + F.lit(NORM_EPS)), F.lit(1.0))
    shifted = (F.col("bias") - F.coalesce("mean", F.lit(0.0))) * F.col("_scale")
    return (
        joined.withColumn("_scale", scale)
        .withColumn("weights", F.transform("weights", lambda w: w * F.col("_scale")))
        .withColumn("bias", shifted + F.coalesce("beta", F.lit(0.0)))
        .select("layer", "unit", "weights", "bias")
    )


def mlp_project(
    df: DataFrame,
    layers: DataFrame,
    activation: str | None = "relu",
    vec: str = "embedding",
    out: str = "latent",
) -> DataFrame:
    """Add the output of dense layers; the activation follows all but the last.

    NaN, infinite and null elements of a vector count as 0. Layers beyond the broadcast limit
    are applied one after the other, in blocks of units.
    """
    k.activate(activation, np.zeros(1))
    stack = fetch_layers(layers)
    if stack is None:
        return _project_in_blocks(df, layers, activation, vec, out)
    shipped = df.sparkSession.sparkContext.broadcast(stack)

    def work(batch):
        stack = shipped.value
        x = k.clean_matrix(_column(batch, vec), stack[0][0].shape[1])
        for depth, (weights, bias) in enumerate(stack):
            x = x @ weights.T + bias
            if depth < len(stack) - 1:
                x = k.activate(activation, x)
        return {out: k.to_lists(x, pa.float64())}

    return _arrow_map(df, df.columns, [_double_list(out)], work)


def _project_in_blocks(df, layers, activation, vec, out) -> DataFrame:
    context = df.sparkSession.sparkContext
    # One row per layer.
    shapes = layers.groupBy("layer").agg(
        F.max("unit").alias("last"), F.max(F.size("weights")).alias("dim")
    ).orderBy("layer").collect()
    current, previous = df.withColumn("_in", F.col(vec).cast("array<double>")), None
    for depth, (layer, last, dim) in enumerate(shapes):
        size = max(1, quantize.BROADCAST_BYTES // (8 * dim))
        current = current.withColumn(out, F.array().cast("array<double>"))
        for low in range(0, last + 1, size):
            block = (F.col("layer") == layer) & F.col("unit").between(low, low + size - 1)
            rows = layers.where(block).orderBy("unit").collect()
            shipped = context.broadcast(
                (np.array([r.weights for r in rows]), np.array([r.bias for r in rows]))
            )
            name = None if depth == len(shapes) - 1 else activation

            def work(batch, shipped=shipped, name=name):
                weights, bias = shipped.value
                x = k.clean_matrix(_column(batch, "_in"), weights.shape[1])
                y = k.activate(name, x @ weights.T + bias)
                return {out: k.to_lists(np.hstack([k.to_matrix(_column(batch, out)), y]), pa.float64())}

            step = materialize(
                _arrow_map(current, current.columns, [_double_list(out)], work), "latent", previous
            )
            shipped.unpersist()
            current = previous = step
        current = current.withColumn("_in", F.col(out))
    return current.select(*df.columns, out)


def fit_projection(df: DataFrame, e_dim: int, vec: str = "embedding") -> DataFrame:
    """One-layer projection with the least squared reconstruction error.

    That is PCA: Spark sums the covariance over all rows, and only the
    width x width matrix reaches the driver. The bias centres the data. Null and ragged vectors
    stop the fit; NaN, infinite and null elements count as 0.
    """
    spark = df.sparkSession
    valid_shape(df, vec)
    table = df.select(array_to_vector(sanitize(vec).cast("array<double>")).alias("_x"))
    model = PCA(k=e_dim, inputCol="_x", outputCol="_y").fit(table)
    axes = model.pc.toArray().T
    mean = table.agg(Summarizer.mean(F.col("_x"))).first()[0].toArray()
    rows = [
        (0, unit, axis.tolist(), float(-axis @ mean)) for unit, axis in enumerate(axes)
    ]
    return spark.createDataFrame(rows, T._parse_datatype_string(LAYER_SCHEMA))


def explained_variance(df: DataFrame, layers: DataFrame, vec: str = "embedding") -> DataFrame:
    """Variance of each projected coordinate and its share of the total."""
    rows = df.select(sanitize(vec).cast("array<double>").alias("_x"))
    projected = mlp_project(rows, layers, None, "_x", "latent")
    spread = [Summarizer.variance(array_to_vector(c)).alias(c) for c in ("_x", "latent")]
    found = projected.agg(F.count("*").alias("n"), *spread).first()  # two vectors of variances
    to_population = (found.n - 1) / found.n
    whole = float(found["_x"].toArray().sum()) * to_population
    rows = [(i, float(v) * to_population) for i, v in enumerate(found.latent.toArray())]
    kept = df.sparkSession.createDataFrame(rows, "component int, variance double")
    return kept.withColumn("share", F.try_divide("variance", F.lit(whole)))
