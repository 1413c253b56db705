"""Rows that share a page id, with equal and other payloads, each come back."""

import hashlib
from collections import Counter

from sidforge.llm.queries import QUERIES


def test_repeated_long_pages(spark, tmp_path):
    long, other = "<p>" + "x" * 200_000, "<p>" + "y" * 200_000
    rows = [(1, "u", long), (1, "u", long), (1, "u", long), (2, "u", "short"), (2, "u", "short"), (4, "v", other),
            (5, "v", other), (5, "v", other), (5, "v", long + "z"), (6, "w", long + "w"), (None, "u", long)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = Counter()
    for page_id, _, html in rows:
        if page_id is not None:
            kind = ("revisit", 5) if page_id == 4 else ("response", None)
            want[page_id, len(html), hashlib.sha1(html.encode()).hexdigest(), *kind] += 1
    assert Counter(map(tuple, QUERIES["op1_warc"](spark, str(tmp_path)).collect())) == want
