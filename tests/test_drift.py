"""Partitions whose files disagree, and the text of numbers."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidforge.functions.text import float_text
from sidforge.sources.items import extract_items, scan_items, stringify


def test_text_of_doubles_is_python_s(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1e-4, 9.999e-5, 1e-5, 1e7, 12345678.5, 1e15, 1e16, 123456789012345678.0, 2e23, 8.41e21,
              1.7976931348623157e308, math.inf, -math.inf, 2.0**-44, 0.1, 1 / 3, 100.0, -1.5e-7]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(2000)]
    values += [rng.choice((-1, 1)) * round(rng.random(), rng.randrange(1, 17)) * 10.0 ** rng.randrange(-9, 20) for _ in range(2000)]
    values = [v for v in values if v == 0 or abs(v) > 2.3e-308]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text(F.col("v")).alias("t"))
    other = [(r.v, r.t) for r in rows.collect() if r.t != str(r.v)]
    assert all(float(t) == v and len(t) == len(str(v)) for v, t in other) and len(other) < 5
    odd = spark.createDataFrame([(math.nan,), (None,)], "v double").select(float_text(F.col("v")).alias("t"))
    assert {r.t for r in odd.collect()} == {"nan", None}
    narrow = [0.1, 1 / 3, 1e-5, 1e20]
    rows = spark.createDataFrame([(v,) for v in narrow], "v float").select(float_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [str(float(np.float32(v))) for v in narrow]


def put(spark, root, name, rows, schema):
    path = f"{root}/items/dt=1/country_code=MX"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}")
    written = next(f for f in __import__("pathlib").Path(f"{root}/{name}").glob("part-*.parquet"))
    target = __import__("pathlib").Path(path)
    target.mkdir(parents=True, exist_ok=True)
    (target / f"part-{name}.parquet").write_bytes(written.read_bytes())


def test_a_late_column_is_read(spark, folder):
    put(spark, folder, "0", [("1", "a")], "item_id string, title string")
    put(spark, folder, "1", [("2", "b", "x")], "item_id string, title string, brand string")
    found = scan_items(spark, folder, "items", "1", "MX").drop("dt", "country_code")
    assert sorted(map(tuple, found.select("item_id", "title", "brand").collect())) == [("1", "a", None), ("2", "b", "x")]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (1, 3, 2, 0)])
def test_types_that_disagree_become_text(spark, folder, order):
    kinds = [
        ([(7, 1)], "item_id int, n int"),
        ([("x", 2)], "item_id string, n bigint"),
        ([(2.0, 3)], "item_id double, n int"),
        ([(True, None)], "item_id boolean, n smallint"),
    ]
    for name, i in enumerate(order):
        put(spark, folder, str(name), *kinds[i])
    for again in range(3):  # more files of the same types
        put(spark, folder, f"9{again}", *kinds[again % 2])
    found = scan_items(spark, folder, "items", "1", "MX")
    assert dict(found.dtypes)["item_id"] == "string" and dict(found.dtypes)["n"] == "bigint"
    want = [("7", 1), ("x", 2), ("2.0", 3), ("True", None), ("7", 1), ("x", 2), ("7", 1)]
    assert sorted(map(tuple, found.select("item_id", "n").collect()), key=str) == sorted(want, key=str)


def test_first_rows_in_file_order_over_files_that_disagree(spark, folder):
    put(spark, folder, "0", [(i, "1.5", "2") for i in range(5)], "item_id int, i_lng string, i_lag string")
    put(spark, folder, "1", [(f"s{i}", 1.5, "2") for i in range(5)], "item_id string, i_lng double, i_lag string")
    put(spark, folder, "2", [("z", None, "2")], "item_id string, i_lng double, i_lag string")
    got = extract_items(spark, folder, "items", "1", "MX", ["item_id", "title", "i_lng", "i_lag", "geohash"], 8)
    rows = [tuple(r) for r in got.orderBy("idx").collect()]
    assert [r[:2] for r in rows] == [*((i, str(i)) for i in range(5)), *((5 + i, f"s{i}") for i in range(3))]
    assert {r[2:5] for r in rows} == {("", "1.5", "2")}
    assert extract_items(spark, folder, "items", "1", "MX").count() == 10  # one has no coordinate
    with pytest.raises(FileNotFoundError):
        scan_items(spark, folder, "items", "1", "BR")


def test_stringify_keeps_nulls_empty_and_spells_types(spark):
    df = spark.createDataFrame([(1e-5, True, None, 3), (None, None, "t", None)], "a double, b boolean, c string, `d.e` int")
    assert [tuple(r) for r in stringify(df).collect()] == [("1e-05", "True", "", "3"), ("", "", "t", "")]
