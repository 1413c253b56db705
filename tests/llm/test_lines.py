"""Line dedup against a plain loop and its SQL twin."""

from collections import defaultdict

import plain
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from sidforge.llm import lines, queries
from sidforge.llm.common import WHITE

LICENCE = "Licensed under the terms of the LICENCE"
ROWS = [
    (1, f"{LICENCE}\nown line one of the first"),
    (2, f"  {LICENCE.lower()}\t\n\n{LICENCE}\nshort"),
    (3, LICENCE),
    (3, LICENCE),
    (4, None),
    (5, ""),
    (None, LICENCE),
    (6, "twice only, in two documents\nshort\r\n"),
    (7, "twice only, in two documents\nshort"),
    (8, "\u00c9\u00e9" * 9 + "x\nshort"),
    (9, "\u00c9\u00e9" * 10),
    (10, "\u00c9\u00e9" * 10 + "\n" + "\u00e9" * 20),
    (11, "\u00c9\u00e9" * 10 + "\n" + "word " * 400_000),
]


def brute(rows):
    def keys(text):
        for line in (text or "").split("\n"):
            yield line, plain.lowered(line.strip(WHITE))

    holders = defaultdict(set)
    for doc, text in rows:
        for _, key in keys(text):
            if doc is not None and len(key) >= 20:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        own = list(keys(text))
        stay = [x for x, k in own if doc is None or len(holders[k]) < 3 or doc == max(holders[k])]
        out.append((doc, len(own), len(own) - len(stay), plain.sha("\n".join(stay))))
    return sorted(out, key=str)


def found(docs, **how):
    kept = lines.drop_repeated_lines(docs, ["doc_id"], **how)
    rows = kept.select("doc_id", "n_lines", "n_dropped", queries.sha256("kept_text")).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_edges(spark, batches):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert found(docs, batches=batches) == brute(ROWS)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    clash = docs.selectExpr("*", *(f"1 as `{c}`" for c in ("hash", "docs", "last", "batch", "_gone", "_row", "Key")))
    kept = lines.drop_repeated_lines(clash, clash.columns)
    assert kept.columns == [*clash.columns, "n_lines", "n_dropped", "kept_text"]
    assert kept.count() == len(ROWS)
    assert found(docs.where("false")) == []


def test_a_line_in_every_document_is_stored_a_few_times(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(LICENCE).alias("text"))
    hashed = lines.line_hashes(docs).withColumn("batch", F.col("doc_id") % 8)
    runs = lines.Runs(spark, 4)
    for n in (7, 0, 1, 2, 3, 4, 5, 6):
        runs.add(hashed.where(F.col("batch") == n).drop("batch"))
    last = runs.compact().collect()
    runs.close()
    assert [(r.docs, r["last"]) for r in last] == [(250, 1999)]


def test_documents_match_brute_force_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)
    name = "op11_lines"
    problem, _ = compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLE[name])
    assert problem == ""
