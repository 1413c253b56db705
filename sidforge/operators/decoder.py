"""The way back from codes to input vectors.

A quantizer behind a projection works in a latent space. Its decoder is the linear map from
the sum of an item's codewords to its input vector with the least squared error. It is found by
the normal equations: tasks add up products of codeword sums with themselves and with the
inputs, and only those sums, (latent width + 1) rows, meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.operators import kernels as k
from sidforge.operators.project import LAYER_SCHEMA, mlp_project
from sidforge.operators.quantize import decode

# Directions of the codeword sums with less than this share of the largest carry no signal.
LEAST_SHARE = 1e-10


def normal_equations(df: DataFrame, inputs: str, targets: str) -> tuple[np.ndarray, np.ndarray, int]:
    """``(A'A, A'Y, rows)`` for ``A`` = ``inputs`` with a 1 behind; null vectors count for nothing."""
    rows = df.where(F.col(inputs).isNotNull() & F.col(targets).isNotNull()).select(inputs, targets)

    def add_up(batches):
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, k.SLICE_ROWS):
                piece = batch.slice(start, k.SLICE_ROWS)
                a, y = k.clean_matrix(piece.column(0)), k.clean_matrix(piece.column(1))
                a = np.hstack([a, np.ones((len(a), 1))])
                found = a.T @ np.hstack([a, y])
                total = found if total is None else total + found
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), k.to_lists(total, pa.float64())], ["unit", "v"])

    parts = rows.mapInArrow(add_up, "unit int, v array<double>")
    sums = parts.groupBy("unit").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    met = np.array([r.v.toArray() for r in sorted(sums.collect(), key=lambda r: r.unit)])
    if not len(met):
        raise ValueError("no rows to fit a decoder on")
    width = len(met)
    return met[:, :width], met[:, width:], int(round(met[-1, width - 1]))


def fit_decoder(coded: DataFrame, codebook: DataFrame, vec: str = "embedding", ridge: float = 0.0) -> DataFrame:
    """One dense layer from codeword sums to vectors, from rows with code columns and ``vec``.

    ``ridge`` adds that much of the mean square of the sums to the diagonal. Directions that no
    codeword sum uses get no weight.
    """
    summed = decode(coded, codebook, "_sum").select("_sum", F.col(vec).alias("_vector"))
    gram, cross, _ = normal_equations(summed, "_sum", "_vector")
    if ridge:
        size = len(gram) - 1
        gram = gram + np.diag([ridge * np.trace(gram[:size, :size]) / size] * size + [0.0])
    solved = np.linalg.lstsq(gram, cross, rcond=LEAST_SHARE)[0]
    rows = [(0, unit, column[:-1].tolist(), float(column[-1])) for unit, column in enumerate(solved.T)]
    return coded.sparkSession.createDataFrame(rows, T._parse_datatype_string(LAYER_SCHEMA))


def decode_projected(
    coded: DataFrame, codebook: DataFrame, decoder: DataFrame, out: str = "reconstruction", activation: str | None = None
) -> DataFrame:
    """Add the input vector that a row's codes stand for, null for a null code."""
    summed = decode(coded, codebook, "_sum")
    known = mlp_project(summed.where("_sum is not null"), decoder, activation, "_sum", out)
    lost = summed.where("_sum is null").withColumn(out, F.lit(None).cast("array<double>"))
    return known.unionByName(lost).drop("_sum")
