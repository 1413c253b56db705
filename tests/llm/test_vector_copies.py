"""Copies of a vector do not take the place of its neighbours in a window."""

import numpy as np

from sidforge.llm import neighbours


def test_copies_change_no_link(spark):
    rng = np.random.default_rng(9)
    base = neighbours.unit(rng.standard_normal((300, 16)))
    near = neighbours.unit(base + 0.3 * neighbours.unit(rng.standard_normal((300, 16))))
    vectors = np.concatenate([base, near]).tolist()

    def found(copies):
        rows = [(i + 1000 * c, v) for i, v in enumerate(vectors) for c in range(copies)]
        table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
        return {r[0]: tuple(r[1:3]) for r in neighbours.link_vectors(table, passes=3, span=8).collect()}

    alone, many = found(1), found(10)
    assert sum(n > 0 for n, _ in alone.values()) > 100
    assert many == {i + 1000 * c: (10 * (n + 1) - 1, root) for i, (n, root) in alone.items() for c in range(10)}
