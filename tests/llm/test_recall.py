"""How many close pairs the projection passes find."""

import numpy as np

from sidforge.llm import neighbours


def test_passes_grow_with_rows():
    passes = [neighbours.passes_for(n) for n in (0, 10, 48, 1000, 50_000, 10**6, 10**8)]
    assert passes[:3] == [1, 1, 1] and passes == sorted(passes) and passes[4:] == [17, 29, 62]


def test_planted_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((1500, 32))
    other -= (other * base[:1500]).sum(axis=1, keepdims=True) * base[:1500]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.9505 * base[:1500] + np.sqrt(1 - 0.9505**2) * other
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(10_000 + i, v.tolist()) for i, v in enumerate(near)]
    found = neighbours.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    links = {r.vec_id: r.component_id for r in found.collect()}
    together = sum(links[i] == links[10_000 + i] for i in range(1500))
    assert together >= 0.995 * 1500
