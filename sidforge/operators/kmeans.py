"""Weighted k-means on distinct vectors, all restarts side by side.

Equal vectors are one point with a weight, so copies cost nothing. A pass over the points serves
every restart: a task assigns its points to the nearest centres of each restart and adds up
weight, vector and cost per centre; these sums, restarts x codes of them for each task, meet by
centre. Only centres reach the driver. A centre that no point chose stays where it is.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.functions.vectors import sanitize
from sidforge.operators import kernels as k
from sidforge.operators import quantize
from sidforge.session import materialize

# Distinct vectors, for each centre, among which the first centres are drawn.
CANDIDATES = 16
# A restart ends when its centres together move less than this share of the points' variance,
# a usual setting for k-means.
TOLERANCE = 1e-4


class Fitted(NamedTuple):
    """Centres (restarts, codes, width), the cost and passes of each restart."""

    centres: np.ndarray
    costs: np.ndarray
    passes: int


def distinct_points(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """``(point, weight)``: each distinct cleaned vector and how often it occurs, written out."""
    points = df.select(sanitize(vec).cast("array<double>").alias("point"))
    # -0.0 and 0.0 group as one value.
    return materialize(points.groupBy("point").agg(F.count("*").alias("weight")), "points")


def _nearest_sums(x: np.ndarray, weight: np.ndarray, centres: np.ndarray):
    """Weight, weighted vector sum and cost of each centre's points."""
    code, gap = k.nearest(x, centres, k.first_copies(centres))
    chosen = np.zeros((len(centres), len(x)))
    chosen[code, np.arange(len(x))] = weight
    return chosen.sum(axis=1), chosen @ x, chosen @ gap


def _pass(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, vector sums and costs by (restart, code)."""
    shipped = points.sparkSession.sparkContext.broadcast(centres)
    restarts, codes, width = centres.shape

    def add_up(batches):
        weights, sums, costs = np.zeros((restarts, codes)), np.zeros((restarts, codes, width)), np.zeros((restarts, codes))
        for batch in batches:
            for start in range(0, batch.num_rows, k.SLICE_ROWS):
                piece = batch.slice(start, k.SLICE_ROWS)
                x = k.to_matrix(piece.column(0))
                weight = piece.column(1).to_numpy()
                for r, own in enumerate(shipped.value):
                    w, s, c = _nearest_sums(x, weight, own)
                    weights[r] += w
                    sums[r] += s
                    costs[r] += c
        place = np.flatnonzero(weights.ravel())
        yield pa.record_batch(
            [pa.array(place, pa.int64()), pa.array(weights.ravel()[place]),
             k.to_lists(sums.reshape(-1, width)[place], pa.float64()), pa.array(costs.ravel()[place])],
            ["place", "weight", "total", "cost"],
        )

    parts = points.mapInArrow(add_up, "place bigint, weight double, total array<double>, cost double")
    met = parts.groupBy("place").agg(
        F.sum("weight").alias("weight"), Summarizer.sum(array_to_vector("total")).alias("total"), F.sum("cost").alias("cost")
    )
    weights, sums, costs = np.zeros(restarts * codes), np.zeros((restarts * codes, width)), np.zeros(restarts * codes)
    for row in met.collect():  # a row per centre
        weights[row.place], sums[row.place], costs[row.place] = row.weight, row.total.toArray(), row.cost
    shipped.unpersist()
    return weights.reshape(restarts, codes), sums.reshape(centres.shape), costs.reshape(restarts, codes)


def lloyd(points: DataFrame, starts: np.ndarray, iters: int, tolerance: float = TOLERANCE) -> Fitted:
    """``iters`` updates of every restart from ``starts``, fewer once all have settled; the costs
    are those of the centres returned."""
    centres = np.array(starts, dtype=np.float64)
    spread = None
    passes = 0
    for _ in range(iters):
        weights, sums, _ = _pass(points, centres)
        passes += 1
        if spread is None:
            spread = _variance(points) if tolerance > 0 else 0.0
        moved = np.where(weights[..., None] > 0, sums / np.maximum(weights, 1e-300)[..., None], centres)
        shift = np.square(moved - centres).sum(axis=(1, 2))
        centres = moved
        if (shift <= tolerance * spread).all():
            break
    costs = _pass(points, centres)[2].sum(axis=1)
    return Fitted(centres, costs, passes + 1)


def _variance(points: DataFrame) -> float:
    """Mean variance of the elements."""
    found = Summarizer.metrics("variance").summary(array_to_vector("point"), F.col("weight").cast("double"))
    variance = points.select(found.alias("s")).first().s.variance.toArray()
    return float(variance.mean()) if np.isfinite(variance).all() else 0.0


def first_centres(points: DataFrame, codes: int, restarts: int, seed: int) -> np.ndarray:
    """Centres drawn apart from each other (by squared distance) from a keyed sample of
    CANDIDATES x codes distinct points, anew for each restart.

    Only where k-means starts depends on the sample; every update reads all points. Fewer
    distinct points than codes repeat in order.
    """
    key = F.md5(F.concat_ws(",", F.lit(str(seed)), F.col("point").cast("string")).cast("binary"))
    rows = points.orderBy(key, "point").limit(CANDIDATES * codes).collect()
    x, weight = np.array([r.point for r in rows]), np.array([r.weight for r in rows], float)
    out = []
    for restart in range(restarts):
        rng = np.random.default_rng([seed, restart])
        picked = [rng.choice(len(x), p=weight / weight.sum())]
        gap = np.square(x - x[picked[0]]).sum(axis=1)
        while len(picked) < min(codes, len(x)):
            chance = gap * weight
            chance[picked] = 0.0
            if chance.sum() <= 0:
                break
            picked.append(rng.choice(len(x), p=chance / chance.sum()))
            gap = np.minimum(gap, np.square(x - x[picked[-1]]).sum(axis=1))
        out.append(x[[picked[i % len(picked)] for i in range(codes)]])
    return np.stack(out)


def fit_centres(
    points: DataFrame, codes: int, iters: int, restarts: int, seed: int, starts: np.ndarray | None = None,
    tolerance: float = TOLERANCE,
) -> Fitted:
    """All restarts, as many side by side as the broadcast limit holds."""
    if starts is None:
        starts = first_centres(points, codes, restarts, seed)
    at_once = max(1, quantize.BROADCAST_BYTES // max(1, starts[0].nbytes))
    parts = [lloyd(points, starts[i : i + at_once], iters, tolerance) for i in range(0, len(starts), at_once)]
    return Fitted(
        np.concatenate([p.centres for p in parts]), np.concatenate([p.costs for p in parts]), sum(p.passes for p in parts)
    )
