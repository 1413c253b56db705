"""Balanced assignment, collisions, ranks and reports."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidforge.functions.tokens import code_token, render_tokens
from sidforge.operators import balance, collisions, fit, identity, joins, quantize, report
from sidforge.operators.skew import join_counted


def normalised_in_turn(d, eps, iters):
    """The matrix itself, rows and columns scaled as the definition says."""
    middle = (d.max() + d.min()) / 2
    q = np.exp(-((d - middle) / (d.max() - middle + 1e-5)) / eps)
    q /= q.sum()
    for _ in range(iters):
        q /= q.sum(axis=1, keepdims=True) * len(d)
        q /= q.sum(axis=0, keepdims=True) * d.shape[1]
    return q * len(d)


def first_largest(q):
    """Lowest code of the largest entry, equal within rounding."""
    return (q >= q.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)


def distance_frame(spark, groups, width, seed=0):
    rng = np.random.default_rng(seed)
    mats = {g: rng.random((n, width)) for g, n in groups.items()}
    rows, idx = [], 0
    for g, m in mats.items():
        for v in m:
            rows.append((idx, g, v.tolist()))
            idx += 1
    return mats, spark.createDataFrame(rows, "idx bigint, batch string, distances array<double>")


@pytest.mark.parametrize("eps", [0.003, 0.05, 0.5])
@pytest.mark.parametrize("task_rows", [1 << 16, 40, 1])
def test_balanced_codes_equal_the_definition(spark, eps, task_rows):
    mats, df = distance_frame(spark, {"a": 100, "b": 30, "c": 3}, 8)
    found = balance.sinkhorn_assign(df, "batch", eps=eps, iters=20, task_rows=task_rows)
    rows = sorted(found.collect(), key=lambda r: r.idx)
    assert len(rows) == 133
    start = 0
    for g, m in mats.items():
        wanted = first_largest(normalised_in_turn(m, eps, 20))
        part = rows[start : start + len(m)]
        assert [r.batch for r in part] == [g] * len(m)
        assert [r.code for r in part] == wanted.tolist()
        start += len(m)


def test_balance_spreads_rows(spark):
    _, df = distance_frame(spark, {"a": 160}, 8)
    tilted = df.withColumn("distances", F.expr("transform(distances, (d, i) -> d / 20 + i)"))
    codes = Counter(r.code for r in balance.sinkhorn_assign(tilted, "batch", eps=0.05, iters=100).collect())
    assert len(codes) == 8 and max(codes.values()) <= 30


def test_balance_limits(spark):
    mats, df = distance_frame(spark, {"a": 50}, 4)
    plain = sorted(balance.sinkhorn_assign(df, "batch", eps=0).collect())
    assert [r.code for r in plain] == mats["a"].argmin(axis=1).tolist()
    with pytest.raises(ValueError, match="underflows"):
        balance.sinkhorn_assign(df, "batch", eps=1e-4)
    same = df.withColumn("distances", F.expr("array(1D, 1D, 1D, 1D)"))
    for task_rows in (100, 10):
        codes = [r.code for r in balance.sinkhorn_assign(same, "batch", task_rows=task_rows).collect()]
        assert codes == [0] * 50


def test_centring(spark):
    mats, df = distance_frame(spark, {"a": 20, "b": 1}, 3)
    rows = balance.center_distances(df, "batch").collect()
    for g, m in mats.items():
        middle = (m.max() + m.min()) / 2
        wanted = (m - middle) / (m.max() - middle + 1e-5)
        assert np.allclose([r.distances for r in sorted(rows) if r.batch == g], wanted)


def hot_codes(spark, n=3000):
    """A third of the rows share one tuple."""
    return spark.range(n).select(
        F.col("id").alias("idx"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("code_0"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("code_1"),
    )


@pytest.mark.parametrize("chunk_rows", [1, 7, 100, 1 << 20])
def test_ranks_across_chunks(spark, chunk_rows):
    rows = collisions.dedup_rank(hot_codes(spark), chunk_rows=chunk_rows).orderBy("idx").collect()
    seen = Counter()
    for r in rows:
        seen[r.code_0, r.code_1] += 1
        assert r.code_2 == seen[r.code_0, r.code_1]
    assert len(rows) == 3000
    assert len({tuple(r)[1:] for r in rows}) == 3000


def test_rank_treats_nulls_as_one_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "idx bigint, g string")
    rows = identity.rank_within(df, ["g"], "idx", chunk_rows=3).orderBy("idx").collect()
    assert [r["rank"] for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


@pytest.mark.parametrize("hot_rows", [1, 100, 1 << 20])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join_equals_plain_join(spark, hot_rows, how):
    rows = hot_codes(spark)
    lookup = (
        collisions.bucket_sizes(rows, ["code_0", "code_1"]).where("code_1 < 5").withColumn("m", F.col("n") * 2)
    )
    got = join_counted(rows, lookup, ["code_0", "code_1"], "n", how, hot_rows)
    wanted = rows.join(lookup, ["code_0", "code_1"], how)
    assert got.columns == wanted.columns
    assert sorted(got.collect(), key=str) == sorted(wanted.collect(), key=str)


def test_counts_against_python(spark):
    df = hot_codes(spark)
    sizes = Counter((r.code_0, r.code_1) for r in df.collect())
    stats = collisions.collision_stats(df).first()
    assert stats[:3] == (3000, len(sizes), max(sizes.values()))
    assert stats.rate == pytest.approx((3000 - len(sizes)) / 3000)
    assert collisions.collision_rate(df).first()[:2] == (3000, len(sizes))
    near = collisions.collision_rate(df, exact=False).first()
    assert abs(near.unique_keys - len(sizes)) <= 0.05 * len(sizes)
    members = collisions.collision_groups(df).collect()
    assert Counter((r.code_0, r.code_1) for r in members) == {k: v for k, v in sizes.items() if v > 1}
    assert all(r.group_size == sizes[r.code_0, r.code_1] for r in members)
    alone = sum(v == 1 for v in sizes.values())
    assert report.exclusive_items(df).first() == (alone, alone / 3000)
    top = report.top_buckets(df, 3).collect()
    best = sorted(((-n, f"<a_{a}><b_{b}>") for (a, b), n in sizes.items()))[:3]
    assert [(-r.bucket_size, r.sid) for r in top] == best


def test_extremes(spark):
    one = spark.range(20).selectExpr("id as idx", "1 as code_0")
    all_own = spark.range(20).selectExpr("id as idx", "int(id) as code_0")
    assert collisions.collision_stats(one).first() == (20, 1, 20, 0.95)
    assert collisions.collision_stats(all_own).first() == (20, 20, 1, 0.0)
    assert collisions.collision_stats(one.limit(0)).first() == (0, 0, 0, 0.0)
    assert collisions.is_unique(all_own).first()[0] and not collisions.is_unique(one).first()[0]
    assert tuple(report.level_usage(one).first()) == (0, 1, 2, 0.0, 1.0, 1.0)
    even = report.level_usage(all_own).first()
    assert even.entropy_ratio == pytest.approx(1.0) and even.top5_share == pytest.approx(0.25)


def test_percentiles_are_cut(spark):
    rows = [(s, i) for s, n in enumerate([1, 1, 2, 5]) for i in range(n)]
    df = spark.createDataFrame(rows, "code_0 int, k int")
    assert report.bucket_percentiles(df).first() == (1, 4, 4)


def test_tokens(spark):
    df = spark.createDataFrame([(0, 1, 2, 3, 4, 5)], "idx int, code_0 int, code_1 int, code_2 int, code_3 int, code_4 int")
    row = render_tokens(df)
    assert tuple(row.first())[1:] == ("<a_1>", "<b_2>", "<c_3>", "<d_4>", "<e_5>")
    assert tuple(report.parse_index(row).first()) == (0, 1, 2, 3, 4, 5)
    with pytest.raises(ValueError, match="no letter"):
        code_token(5, "code_0")
    with pytest.raises(ValueError, match="no letter"):
        render_tokens(df.withColumn("code_5", F.lit(1)))


def test_geo_sid_without_geohash(spark):
    df = spark.createDataFrame([(None, "<a_1>"), ("s0", "<a_2>")], "geohash string, code_0 string")
    assert [r.geo_sid for r in joins.with_geo_sid(df).collect()] == ["<><a_1>", "<s0><a_2>"]
    assert [r.geo_sid for r in joins.with_geo_sid(df.drop("geohash")).collect()] == ["<><a_1>", "<><a_2>"]


def test_geo_reports_agree(spark):
    df = hot_codes(spark).withColumn("geohash", F.expr("case idx % 4 when 0 then null when 1 then '' else 's' end"))
    one = sorted(map(tuple, report.geo_collision(df).collect()))
    two = sorted(map(tuple, report.geo_collision_sets(df).collect()))
    assert [r[0] for r in one] == ["geo_sid", "sid"]
    for a, b in zip(one, two):
        assert a[:4] + a[5:6] == b[:4] + b[5:6] and a[4] == pytest.approx(b[4])
    assert report.distinct_geohashes(df).first()[0] == 2
    plain = report.geo_collision(df.drop("geohash")).collect()
    assert [r.scope for r in plain] == ["sid"]


def test_repeated_vectors(spark):
    rows = [([0.0, 1.0],), ([-0.0, 1.0],), ([2.0, 1.0],), ([2.0, 1.0],), ([3.0, 1.0],)]
    df = spark.createDataFrame(rows, "embedding array<float>").withColumn("idx", F.monotonically_increasing_id())
    assert report.dup_vectors(df).first() == (5, 3, 2, 40.0)
    assert report.dup_vectors(df.limit(0)).first() == (0, 0, 0, None)
    norms = report.norm_stats(df).first()
    assert norms.n == 5 and norms.max_norm == pytest.approx(math.sqrt(10))
    assert norms.median_norm == pytest.approx(math.sqrt(5))
    four = df.orderBy(F.desc("embedding")).offset(1)
    assert report.norm_stats(four).first().median_norm == pytest.approx((1 + math.sqrt(5)) / 2)
    assert report.norm_stats(df.limit(0)).first().median_norm is None


def repair_case(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    # A third of the items stand close together and share most codes.
    x[: n // 3] = x[0] + rng.normal(size=(n // 3, 4)) * 0.05
    books = [rng.normal(size=(3, 4)), rng.normal(size=(3, 4)) * 0.5, rng.normal(size=(16, 4)) * 0.3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, embedding array<double>")
    return x, books, df, fit.codebook_table(spark, books)


def repaired_by_hand(x, books, rounds, eps, iters):
    rest, codes = x, []
    for book in books[:-1]:
        c = ((rest[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        rest = rest - book[c]
        codes.append(c)
    d = ((rest[:, None] - books[-1][None]) ** 2).sum(axis=2)
    codes = np.stack([*codes, d.argmin(axis=1)], 1)
    for _ in range(rounds):
        groups = {}
        for i, c in enumerate(map(tuple, codes.tolist())):
            groups.setdefault(c, []).append(i)
        crowded = [g for g in groups.values() if len(g) > 1]
        if not crowded:
            break
        for g in crowded:
            codes[g, -1] = first_largest(normalised_in_turn(d[g], eps, iters))
    return codes


@pytest.mark.parametrize("task_rows", [1 << 16, 60])
def test_repair_equals_rounds_by_hand(spark, task_rows):
    x, books, df, table = repair_case(spark)
    wanted = repaired_by_hand(x, books, 4, 0.05, 30)
    found = collisions.resolve_collisions(df, table, 4, 0.05, 30, task_rows=task_rows)
    rows = sorted(found.collect(), key=lambda r: r.idx)
    got = np.array([tuple(r)[1:] for r in rows])
    before = np.array([tuple(r)[1:] for r in sorted(quantize.assign_codes(df, table, keep=["idx"]).collect())])
    assert (got[:, :2] == before[:, :2]).all()
    assert (got == wanted).all()
    rate = lambda c: 1 - len(set(map(tuple, c.tolist()))) / len(c)
    assert rate(got) < rate(before)
    assert collisions.collision_stats(found).first().rate == pytest.approx(rate(got))


def test_repair_leaves_unique_tuples_alone(spark):
    table = fit.codebook_table(spark, [[[0.0], [10.0]], [[0.0], [1.0], [2.0]]])
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate([0.0, 1.0, 2.0, 10.0, 11.0])], "idx bigint, embedding array<double>")
    rows = sorted(collisions.resolve_collisions(df, table).collect())
    assert [tuple(r)[1:] for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_repair_of_a_single_level(spark):
    book = np.array([[0.0], [1.0], [2.0], [3.0], [4.0]])
    x = np.array([[0.9], [1.1], [3.0], [1.2], [3.3]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, embedding array<double>")
    table = fit.codebook_table(spark, [book])
    rows = sorted(collisions.resolve_collisions(df, table, 3, 0.05, 50).collect())
    assert [r.code_0 for r in rows] == repaired_by_hand(x, [book], 3, 0.05, 50)[:, 0].tolist()


@pytest.mark.parametrize("task_rows", [None, 40])
def test_balanced_levels_and_repair_ignore_the_broadcast_limit(spark, monkeypatch, task_rows):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 4))
    books = [rng.normal(size=(5, 4)), rng.normal(size=(4, 4)), rng.normal(size=(6, 4))]
    df = spark.createDataFrame(
        [(i, i % 2, v.tolist()) for i, v in enumerate(x)], "idx bigint, batch int, embedding array<double>"
    )
    table = fit.codebook_table(spark, books)
    found = []
    for limit in (quantize.BROADCAST_BYTES, 100):
        monkeypatch.setattr(quantize, "BROADCAST_BYTES", limit)
        balanced = balance.assign_codes_balanced(
            df, table, "batch", [0.05, 0.0, 0.05], iters=5, task_rows=task_rows
        )
        assert balanced.columns == ["idx", "batch", "code_0", "code_1", "code_2"]
        repaired = collisions.resolve_collisions(df, table, 2, 0.05, 5, task_rows=task_rows)
        assert repaired.columns == ["idx", "code_0", "code_1", "code_2"]
        found.append((sorted(balanced.collect()), sorted(repaired.collect())))
    assert found[0] == found[1] and len(found[0][1]) == 120
