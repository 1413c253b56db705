"""Nulls, empty tables, repeated rows, very long texts and clashing columns."""

import corpus_pipeline
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sidforge.llm import bpe, compress, fingerprint, language, minhash, mixing, neighbours, repeats, secrets, warc

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(150_000))
ROWS = [
    (1, "Der schnelle Fuchs springt. " * 3, "de", "a", 84),
    (1, "Der schnelle Fuchs springt. " * 3, "de", "a", 84),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "the quick brown fox jumps over the lazy dog", "en", None, 43),
    (4, " \t\n ", "en", "a", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG + " end", "en", "b", len(LONG) + 4),
    (7, "1234 !!! é", None, "", 10),
    (-3, "password=abcdef0123456789abcdef01", "en", "a", 33),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    clash = [f"cast({i} as int) as `{c}`" for i, c in enumerate(("ids", "found", "size", "_doc", "words", "Root", "_key", "tie"))]
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", *clash)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def operators(spark):
    ranks = bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern = public_tokenizers.PATTERN
    sized = F.expr("doc_id"), F.expr("source"), mixing.token_count("text").alias("size")
    return {
        "fingerprint": fingerprint.fingerprint_documents,
        "repeats": lambda d: repeats.remove_repeats(d, ["doc_id"]),
        "bpe": lambda d: bpe.round_trip(d, ranks, pattern, ["doc_id"]),
        "decode": lambda d: bpe.decode(bpe.encode(d, ranks, pattern, ["doc_id"]), ranks, ["doc_id"]),
        "quality": lambda d: compress.score(d, compress.learn(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")), ["doc_id"]),
        "mixing": lambda d: mixing.mix(d.select(*sized)),
        "language": lambda d: language.identify(d, language.learn_prototypes(d), ["doc_id"]),
        "secrets": lambda d: secrets.span_columns(secrets.scan(d, ["doc_id"]), ["doc_id"]),
        "minhash": minhash.near_duplicates,
    }


NAMES = ("fingerprint", "repeats", "bpe", "decode", "quality", "mixing", "language", "secrets", "minhash")


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(spark, docs, empty, name):
    operator = operators(spark)[name]
    ids = sorted((r[0] is None, r[0]) for r in docs.select("doc_id").collect())
    found = operator(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in found) == ids
    same = [tuple(r) for r in found if r.doc_id == 1]
    assert same[0] == same[1]
    assert operator(empty).count() == 0


def test_stages_keep_columns_and_survive_edges(spark, docs, empty, tmp_path):
    for start in (docs, empty):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = f"{tmp_path}/{start is docs}-{name}"
            stage(spark, rows, None).write.parquet(path)
            rows = spark.read.parquet(path)
            assert rows.columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, rows, None)
        assert last.where("not round_trip").count() == 0
        assert (last.count() > 0) == (start is docs)


def test_pages(spark, tmp_path):
    big = "<p>" + "é" * 200_000
    rows = [(1, "http://x y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "a" * 999), (6, "u", "a" * 999),
            (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 9000), (None, "u", "lost"), (9, "u", "b" * 1000), (8, "u", "b" * 1000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archives(warc.revisit_plan(pages), f"{tmp_path}/w")
    records = warc.read_records(spark, f"{tmp_path}/w")
    assert records.where("record_type = 'continuation'").count() >= 6
    found = {warc_id: r for r in warc.payloads(warc.reassemble(records)).collect() for warc_id in [int(r.record_id[10:-1])]}
    assert set(found) == set(range(1, 10))
    revisits = {1: 2, 8: 9}
    for page_id, _, html in rows:
        if page_id is None:
            continue
        data = (html or "").encode()
        r = found[page_id]
        assert r.payload_bytes == len(data)
        assert r.record_type == ("revisit" if page_id in revisits else "response")
        assert r.refers_to == (f"<urn:page:{revisits[page_id]}>" if page_id in revisits else None)
        assert r.payload == (None if page_id in revisits else data)


@pytest.mark.parametrize("change", ["drop", "repeat", "total", "first"])
def test_broken_segments_stop_the_job(spark, change):
    parts = list(warc.page_records(5, "u", b"x" * 300_000, None))
    rows = [next(iter(warc.parse_archive(p + b"\r\n\r\n"))) for p in parts]
    if change == "drop":
        del rows[1]
    if change == "first":
        del rows[0]
    if change == "repeat":
        rows.append(rows[1])
    if change == "total":
        rows[-1][0]["warc-segment-total-length"] = "17"
    table = spark.createDataFrame(
        [(f["warc-record-id"], f.get("warc-segment-origin-id", f["warc-record-id"]), f["warc-type"], None, None, f.get("warc-payload-digest"),
          int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, bytearray(b))
         for f, b in rows], warc.RECORD)
    with pytest.raises(Exception, match="do not add up"):
        warc.reassemble(table).collect()


@pytest.mark.parametrize("bad", [b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b"zz\r\nabc\r\n"])
def test_broken_chunks_are_refused(bad):
    with pytest.raises(ValueError):
        warc.dechunk(bad)
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_vectors(spark):
    nan = float("nan")
    near = [1.0, 0.01, 0.0]
    rows = [(1, [1.0, 0.0, 0.0]), (2, near), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, nan, 0.0]), (6, [1.0, None, 0.0]),
            (7, []), (8, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1e-300, 0.0, 0.0]), (2, near), (11, [0.0, 0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = [tuple(r) for r in neighbours.link_vectors(table).collect()]
    assert len(found) == len(rows)
    by = {r[0]: r for r in found}
    assert by[1] == (1, 2, 1, True) and by[2] == (2, 2, 1, False) and by[10] == (10, 2, 1, False)
    for alone in (3, 4, 5, 6, 7, 8, 9, 11):
        assert by[alone] == (alone, 0, alone, True)
    assert by[None] == (None, 0, None, True)
    assert neighbours.link_vectors(table.where("false")).count() == 0


def test_plain_words_are_the_engines_words(spark, docs):
    counts = {r[0]: r[1] for r in docs.select("doc_id", mixing.token_count("text")).collect()}
    for doc, text, *_ in ROWS:
        assert counts[doc] == len(plain.words(text))
