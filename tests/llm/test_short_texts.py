"""The language stage keeps short clean texts."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
import pytest


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    path = f"{sf_dir.replace('0.001', '0.01')}/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text, lang, n_chars from '{path}'").fetchall()
    rng = random.Random(32)
    top = max(r[0] for r in rows)
    added = {}
    # Words of the corpus as texts of their own, labelled or not; they teach nothing.
    for lang in ("de", "en", "es", "fr"):
        words = sorted({w for r in rows if r[2] == lang for w in (r[1] or "").split() if w.isalpha()})
        for n in range(60):
            text = " ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 5]))) + "."
            if n % 6 == 0:
                text = " ".join([text] * 200)
            added[top + 1 + len(added)] = (lang, text)
    for lang, text in (("none", "1234 !!! 5678"), ("none", " ")):
        added[top + 1 + len(added)] = (lang, text)
    for _ in range(20):
        added[top + 1 + len(added)] = ("far", "".join(rng.choices("абвгдежзийклмнопрст   ", k=1500)))
    table = [(d, t, lang, n) for d, t, lang, n in rows] + [(d, t, None, len(t)) for d, (_, t) in added.items()]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, n_chars bigint").repartition(8)
    after = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, None).collect()}
    return rows, added, after


def test_short_clean_texts_of_each_language_stay(kept):
    _, added, after = kept
    lost = Counter(lang for d, (lang, _) in added.items() if d not in after)
    assert not {k: n for k, n in lost.items() if k in ("de", "en", "es", "fr")}
    assert lost["none"] == 2 and lost["far"] == 20


def test_labelled_texts_with_letters_stay(kept):
    rows, _, after = kept
    assert {d for d, text, lang, _ in rows if lang and any(c.isalpha() for c in text or "")} <= after
