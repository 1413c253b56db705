"""Choice, validation and cleaning of vectors; text encoders."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidforge.functions.vectors import inf_count, nan_count, sanitize
from sidforge.operators import embed, quantize
from sidforge.sources import vectors


@pytest.mark.parametrize(
    "columns, name, expected",
    [
        (["a", "b"], "b", "b"),
        (["only"], None, "only"),
        (["id", "Item_Emb"], None, "Item_Emb"),
        (["id", "features"], None, "features"),
        (["emb_a", "vector_b"], None, None),
        (["a", "b"], None, None),
    ],
)
def test_column_choice(columns, name, expected):
    assert vectors.resolve_vector_column(columns, name) == expected


def test_missing_named_column():
    with pytest.raises(ValueError, match="not among"):
        vectors.resolve_vector_column(["a"], "b")


def test_wide_only_when_all_numeric(spark):
    wide = spark.createDataFrame([(1, 2.5, 3)], "a int, b double, c long")
    assert vectors.load_vectors_wide(wide).first().embedding == [1.0, 2.5, 3.0]
    with pytest.raises(ValueError):
        vectors.load_vectors(wide)
    with pytest.raises(ValueError):
        vectors.load_vectors_wide(wide.withColumn("d", F.lit("x")))


def test_wide_csv(spark, folder):
    spark.createDataFrame([(1, 2.5), (3, 4.5)], "a int, b double").write.csv(f"{folder}/t", header=True)
    read = spark.read.csv(f"{folder}/t", header=True, inferSchema=True)
    assert sorted(r.embedding for r in vectors.load_vectors_wide(read).collect()) == [[1.0, 2.5], [3.0, 4.5]]


def frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "embedding array<float>")


def test_validation(spark):
    assert vectors.validate_vectors(frame(spark, [[1.0, 2.0], [3.0, 4.0]])) == 2
    with pytest.raises(ValueError, match="no vectors"):
        vectors.validate_vectors(frame(spark, [[1.0]]).limit(0))
    with pytest.raises(ValueError, match="null"):
        vectors.validate_vectors(frame(spark, [[1.0], None]))
    # Equal in total, ragged in fact.
    with pytest.raises(ValueError, match="ragged"):
        vectors.validate_vectors(frame(spark, [[1.0], [1.0, 2.0, 3.0]]))


def test_ragged_rows_stop_a_kernel(spark):
    book = spark.createDataFrame([(0, 0, [0.0, 0.0])], "level int, code int, centroid array<double>")
    with pytest.raises(Exception, match="ragged"):
        quantize.assign_codes(frame(spark, [[1.0], [1.0, 2.0, 3.0]]).coalesce(1), book).collect()


def test_sanitize(spark):
    df = frame(spark, [[math.nan, math.inf, -math.inf, None, -0.0, 1.5]])
    row = df.select(
        sanitize("embedding").alias("v"), nan_count("embedding").alias("n"), inf_count("embedding").alias("i")
    ).first()
    assert row.v == [0.0, 0.0, 0.0, 0.0, 0.0, 1.5] and (row.n, row.i) == (2, 2)
    assert df.select(sanitize("embedding").alias("v")).schema["v"].dataType.simpleString() == "array<float>"


def test_dimension_warning(spark):
    assert tuple(vectors.dim_mismatch(frame(spark, [[1.0], [1.0, 2.0]]), 2).first()) == (2, 2, 1)


def test_word_encoder(spark):
    df = spark.createDataFrame([(0, "b a\tb"), (1, ""), (2, None)], "k int, t string")
    rows = {r.k: np.array(r.embedding) for r in embed.embed_text(df, "t", 32).collect()}
    assert np.isclose(np.linalg.norm(rows[0]), 1.0)
    assert sorted(v for v in rows[0] if v) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert not rows[1].any() and not rows[2].any() and len(rows[2]) == 32


def test_plugged_encoder_sees_whole_texts_in_batches(spark):
    def factory():
        return lambda texts: np.array([[len(t), len(texts)] for t in texts])

    df = spark.createDataFrame([(i, "x" * (i * 1000)) for i in range(10)], "k int, t string").coalesce(1)
    found = embed.embed_text(df, "t", factory=factory, batch=4).orderBy("k").collect()
    assert [r.embedding[0] for r in found] == [1000.0 * i for i in range(10)]
    assert max(r.embedding[1] for r in found) <= 4
