"""Order statistics against sorting."""

import math
import random

import numpy as np
import pytest

from sidforge.operators import order, report


def test_bits_order_as_numbers():
    values = np.array([-np.inf, -1e300, -2.0, -1.0, -1e-310, 0.0, 1e-310, 1.0, 1.0 + 2**-52, 1e300, np.inf, np.nan])
    keys = order.ordered_bits(values)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert [order.value_of(int(k)) for k in keys[:-1]] == values[:-1].tolist()
    assert order.ordered_bits(np.array([-0.0]))[0] == keys[5]


def test_places_and_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice((1.0, -2.5, rng.gauss(0, 1e3), rng.gauss(0, 1e-3))) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double")
    places = [0, 1, 700, 1499, 2998, 2999]
    assert order.select_places(df, places) == [sorted(values)[p] for p in places]
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    assert np.allclose(order.quantiles(df, shares), np.quantile(values, shares))
    with pytest.raises(ValueError, match="place"):
        order.select_places(df, [3000])
    weighted = spark.createDataFrame([(3.0, 5), (1.0, 4), (2.0, 0)], "v double, n bigint")
    assert order.select_places(weighted, [3, 4, 8], "n") == [1.0, 3.0, 3.0]
    assert order.quantiles(df.where("false"), [0.5]) == [None]


def test_equal_norms_stay_where_they_are(spark):
    rows = spark.range(50_000, numPartitions=8).selectExpr("id as idx", "array(float(0.6), float(0.8)) as embedding")
    stats = report.norm_stats(rows).first()
    assert stats.n == 50_000 and stats.median_norm == stats.max_norm == stats.min_norm
    assert math.isclose(stats.median_norm, 1.0, rel_tol=1e-6)
