"""Scan, projection, cleaning, geohash and text edge cases."""

import pytest
from pyspark.sql import functions as F

from sidforge.functions.geo import with_geohash
from sidforge.functions.text import item_text, strip
from sidforge.operators import identity, joins
from sidforge.sources import items, sinks


def geohashes(spark, points, precision=6):
    rows = [(i, *p) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "k int, i_lng string, i_lag string")
    return [r.geohash for r in with_geohash(df, precision=precision).orderBy("k").collect()]


def bisected(lng, lat, precision):
    """Plain halving of the ranges, the upper half on a border."""
    low, high = [-180.0, -90.0], [180.0, 90.0]
    bits = []
    for i in range(5 * precision):
        axis, value = i % 2, (lng, lat)[i % 2]
        middle = (low[axis] + high[axis]) / 2
        bits.append(value >= middle)
        (low if value >= middle else high)[axis] = middle
    text = "0123456789bcdefghjkmnpqrstuvwxyz"
    return "".join(
        text[int("".join("01"[b] for b in bits[k : k + 5]), 2)] for k in range(0, len(bits), 5)
    )


def test_geohash_known_points(spark):
    assert geohashes(spark, [("-5.6", "42.6"), ("0", "0"), (" 0 ", "0\t")]) == ["ezs42e", "s00000", "s00000"]


@pytest.mark.parametrize("precision", [1, 4, 5, 6, 9, 12])
def test_geohash_equals_bisection(spark, precision):
    points = [
        (x / 7.0, y / 3.0) for x in range(-1260, 1261, 97) for y in range(-270, 271, 31)
    ] + [(-180.0, -90.0), (180.0, 90.0), (180.0, -90.0), (45.0, 22.5), (-0.0, 0.0), (1e-9, -1e-9)]
    got = geohashes(spark, [(repr(a), repr(b)) for a, b in points], precision)
    assert got == [bisected(a, b, precision) for a, b in points]


def test_geohash_without_a_place(spark):
    bad = [None, "", "  ", "abc", "nan", "inf", "1.5d", "181", "1e400", "1__0", "_1"]
    assert geohashes(spark, [(b, "1") for b in bad] + [("1", b) for b in bad] + [("0", "91")]) == [
        None
    ] * (2 * len(bad) + 1)
    assert geohashes(spark, [("1_0", "1e1")]) == geohashes(spark, [("10", "10.")])


def test_geohash_of_numeric_columns(spark):
    df = spark.createDataFrame([(-5.6, 42.6), (1e-5, None)], "i_lng double, i_lag double")
    assert [r.geohash for r in with_geohash(df).collect()] == ["ezs42e", None]


def test_geohash_rejects_a_precision(spark):
    with pytest.raises(ValueError):
        geohashes(spark, [("0", "0")], 13)


def test_item_text_keeps_inner_blanks(spark):
    rows = [
        ("B", "", "D"), ("\tB\n", " T ", "D\r\n"), (None, None, None), (None, "T", None),
        ("　B\xa0", " T", "\x1fD\x85"), ("", "", "D"),
    ]
    df = spark.createDataFrame(rows, "brand string, title string, description string")
    expected = [" ".join((v or "").strip() for v in row).strip() for row in rows]
    assert [r[0] for r in df.select(item_text()).collect()] == expected
    assert expected[0] == "B  D"


def test_strip_equals_python(spark):
    every = [f"{chr(c)}x{chr(c)}" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(t,) for t in every], "t string")
    assert [r[0] for r in df.select(strip("t")).collect()] == [t.strip() for t in every]


def test_blank_coordinates_are_dropped_and_text_stays(spark):
    rows = [("1", "2"), ("", "2"), (" \t", "2"), (None, "2"), ("abc", "2"), ("1", None), ("1", "　")]
    df = spark.createDataFrame(rows, "i_lng string, i_lag string")
    assert [tuple(r) for r in items.drop_blank_geo(df).collect()] == [("1", "2"), ("abc", "2")]
    assert items.geo_drop_stats(df).first()[:3] == (7, 5, 2)
    assert items.geo_drop_stats(df.limit(0)).first() == (0, 0, 0, None)


def test_absent_fields_and_derived_geohash(spark):
    df = spark.createDataFrame([("7", 0.0, 0.0, "stale")], "item_id string, i_lng double, i_lag double, geohash string")
    picked = items.select_fields(df, ["item_id", "brand", "geohash"])
    assert tuple(picked.first()) == ("7", None, "s00000")
    assert tuple(items.stringify(picked).first()) == ("7", "", "s00000")
    bare = items.select_fields(df.select("item_id"), ["item_id", "geohash"])
    assert tuple(bare.first()) == ("7", None)


def write_partition(spark, folder, n=50, files=5):
    df = spark.range(n).select(F.col("id").cast("string").alias("item_id"))
    target = f"{folder}/items/dt=007/country_code=MX"
    df.repartitionByRange(files, F.col("item_id").cast("int")).write.parquet(target)
    return target


def test_scan_reads_part_files_only(spark, folder):
    target = write_partition(spark, folder)
    spark.range(3).write.parquet(f"{folder}/other")
    from pathlib import Path

    extra = next(Path(f"{folder}/other").glob("part-*.parquet"))
    (Path(target) / "extra.parquet").write_bytes(extra.read_bytes())
    found = items.scan_items(spark, folder, "items", "007", "MX")
    assert found.count() == 50
    assert found.select("dt", "country_code").distinct().collect() == [("007", "MX")]
    for country in ("BR",):
        with pytest.raises(FileNotFoundError):
            items.scan_items(spark, folder, "items", "007", country)


def test_scan_rejects_a_folder_without_data(spark, folder):
    from pathlib import Path

    empty = Path(f"{folder}/items/dt=1/country_code=MX")
    empty.mkdir(parents=True)
    (empty / "_SUCCESS").touch()
    with pytest.raises(FileNotFoundError):
        items.scan_items(spark, folder, "items", "1", "MX")


@pytest.mark.parametrize("n", [-1, 0, 1, 17, 50, 500])
def test_take_first_follows_file_order(spark, folder, n):
    write_partition(spark, folder)
    head = identity.take_first(items.scan_items(spark, folder, "items", "007", "MX").drop("dt"), n)
    rows = sorted((r.idx, int(r.item_id)) for r in head.collect())
    wanted = 50 if n == -1 else min(n, 50)
    assert rows == [(i, i) for i in range(wanted)]


def test_with_idx_spreads_equal_keys(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    rows = identity.with_idx(df, ["k"]).collect()
    assert sorted(r.idx for r in rows) == list(range(5000))
    by_idx = [r.k for r in sorted(rows, key=lambda r: r.idx)]
    assert by_idx == sorted(by_idx)


def test_join_check_names_the_strays(spark):
    left, right = spark.range(5).toDF("idx"), spark.range(1, 6).toDF("idx")
    assert sorted(map(tuple, joins.join_audit(left, right).collect())) == [(0, "items", 1), (5, "index", 1)]
    twice = left.union(spark.createDataFrame([(2,), (None,)], "idx bigint"))
    assert {tuple(r) for r in joins.join_audit(twice, right).collect()} == {
        (0, "items", 1), (5, "index", 1), (2, "items", 2), (None, "items", 1)
    }
    with pytest.raises(Exception, match="unmatched row of items: 0"):
        joins.join_index(left.where("idx < 3"), right.where("idx < 3")).collect()
    with pytest.raises(Exception, match="unmatched row of index: 5"):
        joins.join_index(left.where("idx > 0"), right).collect()
    with pytest.raises(Exception, match="repeated row number: 2"):
        joins.join_index(left, left.union(left.where("idx = 2"))).collect()
    assert joins.join_index(left, left).count() == 5
    assert joins.join_index(left, right, check=False).count() == 4


def test_finalize_modes(spark):
    df = spark.createDataFrame([(None, 3)], "item_id string, shop_id int").withColumn("geo_sid", F.lit("<>"))
    filled = joins.finalize(df).first().asDict()
    raw = joins.finalize(df, fill_nulls=False).first().asDict()
    assert filled["item_id"] == "" and filled["shop_id"] == "3" and filled["brand"] == ""
    assert raw["item_id"] is None and raw["shop_id"] == 3 and raw["brand"] == ""
    assert list(filled) == joins.FINAL_FIELDS + ["geo_sid"]


def test_joined_sink_counts_rows(spark, folder):
    df = spark.range(4)
    assert sinks.write_joined(df, f"{folder}/a", 4).count() == 4
    with pytest.raises(ValueError, match="expected 5"):
        sinks.write_joined(df, f"{folder}/b", 5)
