"""Every operator against brute force or held-out labels, on a whole small table."""

import base64
import itertools
import json
import random

import duckdb
import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from sidforge.llm import bpe, fingerprint, minhash, mixing, neighbours, repeats, secrets
from sidforge.llm.common import components, word_hashes
from sidforge.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(sf_dir):
    return duckdb.sql(f"select doc_id, text, lang, source from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def texts(documents):
    return [r[:2] for r in documents]


def rows(spark, name, sf_dir):
    return [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]


def test_op1(spark, sf_dir):
    import hashlib

    pages = duckdb.sql(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall()
    body = {p: (h or "").encode() for p, h in pages}
    last: dict[bytes, int] = {}
    for p, b in body.items():
        last[b] = max(last.get(b, p), p)
    want = []
    for p, b in body.items():
        again = len(b) >= 1000 and last[b] != p
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    assert sorted(rows(spark, "op1_warc", sf_dir)) == sorted(want)


def test_op2(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in QUERIES["op2_fingerprint"](spark, sf_dir).collect()}
    assert len(found) == len(texts)
    for (doc, text), (_, after) in zip(texts, texts[1:] + texts[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), plain.sha(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text: dict = {}
    for doc, text in texts:
        by_text.setdefault(text, set()).add(found[doc].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert np.mean([r.near_edited for r in found.values()]) > np.mean([r.near_next for r in found.values()]) + 0.2


def test_fingerprint_is_a_sum_over_pieces(spark):
    from pyspark.sql import functions as F

    data = [("One. Two!\nThree? ", "Three? One. Two!\n", "Two!\n")]
    df = spark.createDataFrame(data, "a string, b string, c string")
    pieces = df.select(fingerprint.paragraphs(F.col("a"))).first()[0]
    assert "".join(pieces) == data[0][0]
    vector = {}
    for c in "abc":
        each = df.select(F.lit(1).alias("k"), F.explode(fingerprint.paragraphs(F.col(c))).alias("p"))
        vector[c] = fingerprint.sum_pieces(each, ["k"], "p", f"v{c}")
    df = vector["a"].join(vector["c"], "k")
    less = fingerprint.combine(F.col("va"), F.col("vc"), -1)
    r = df.select(
        (F.col("va")[0] == 4).alias("n"),
        (fingerprint.fingerprint(F.col("va")) == fingerprint.fingerprint(fingerprint.combine(less, F.col("vc")))).alias("back"),
        fingerprint.likeness(F.col("va"), F.col("va")).alias("one"),
    ).first()
    assert r.n and r.back and r.one == 1.0
    turned = spark.createDataFrame([(1, p) for p in reversed(pieces)], "k int, p string")
    again = fingerprint.sum_pieces(turned, ["k"], "p", "v").select(fingerprint.fingerprint(F.col("v"))).first()[0]
    assert again == vector["a"].select(fingerprint.fingerprint(F.col("va"))).first()[0]


def test_op3(spark, sf_dir, texts):
    assert sorted(rows(spark, "op3_repeats", sf_dir)) == sorted(plain.repeats(texts))


def test_repeats_of_all_lengths(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    data = []
    for doc in range(60):
        w = [f"u{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(60)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[a : a + rng.choice([5, 12, 13, 14, 20, 40])]
        data.append((rng.randrange(10**9), " ".join(w)))
    data.append((data[0][0], data[1][1]))
    found = repeats.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string"), ["doc_id"]).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, plain.sha(r.kept_text)) for r in found)
    assert got == sorted(plain.repeats(data))


def test_word_hashes_tell_words_apart():
    column = pa.array(["a b a", "  b\x0ba\n", None, "", "é x a", "ab ba"])
    offsets, hashes = word_hashes(column)
    assert list(offsets) == [0, 3, 5, 5, 5, 7, 9]
    flat = list(itertools.chain.from_iterable(plain.words(t) for t in column.to_pylist()))
    assert len(set(hashes.tolist())) == len(set(flat))
    part = word_hashes(column.slice(1, 4))
    assert (part[1] == hashes[3:7]).all() and list(part[0]) == [0, 2, 2, 2, 4]


def test_op4(spark, sf_dir, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text in texts:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(text or "")))
    assert sorted(rows(spark, "op4_bpe", sf_dir)) == sorted(want)


def test_bpe_on_odd_texts():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    rng = random.Random(1)
    letters = list("abc  \n\t\r'stre'll'VE123½²،٣漢字かな😀éßœ\x1c\x1d\x1e\x1f\x85\xa0 　_-!?<|endoftext|>\x00\x7f")
    for n in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        if n % 100 == 0:
            text = "=" * rng.randint(40, 3000) + text + "ab" * rng.randint(20, 200)
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()
    with pytest.raises(ValueError, match="not in the vocabulary"):
        decoder.decode([len(ranks) + 5])
    with pytest.raises(ValueError, match="not in the vocabulary"):
        bpe.fold_merges(b"zz", {b"a": 0})


def test_op5(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    found = {r.doc_id: r for r in QUERIES["op5_quality"](spark, big).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{big}/labels.parquet'").fetchall()
    assert all(r.held_out == (plain.crc(d, 5) == 0) and r.predicted == (r.score >= 0.3) for d, r in found.items())
    held = [(q, found[d]) for d, q in labels if found[d].held_out]
    assert np.mean([r.predicted == q for q, r in held]) >= 0.95


def test_op6(spark, sf_dir, documents):
    found = {r.doc_id: r for r in QUERIES["op6_mixing"](spark, sf_dir).collect()}
    sizes: dict = {}
    for doc, text, _, source in documents:
        assert found[doc].size == len(plain.words(text))
        sizes[source] = sizes.get(source, 0) + found[doc].size
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= full
    taken: dict = {}
    for doc, _, _, source in documents:
        r = found[doc]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    longest = max(r.size for r in found.values())
    for s in names:
        assert abs(taken[s] - target[s]) <= longest
    again = {r.doc_id: r.taken for r in QUERIES["op6_mixing"](spark, sf_dir).collect()}
    assert again == {d: r.taken for d, r in found.items()}


def test_mix_does_not_depend_on_how_rows_are_dealt(spark):
    data = [(i, ["a", "b", None][i % 3 if i % 7 else 0], i % 50) for i in range(3000)]
    table = spark.createDataFrame(data, "doc_id bigint, source string, size bigint")
    first = sorted(map(tuple, mixing.mix(table).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(table.repartition(13)).collect()), key=str)


def test_op7(spark, sf_dir, documents):
    found = {r.doc_id: r for r in QUERIES["op7_language"](spark, sf_dir).collect()}
    right = []
    for doc, _, lang, _ in documents:
        r = found[doc]
        assert r.held_out == (plain.crc(doc, 4) == 2) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == lang)
    assert np.mean(right) >= 0.95


def der(tag: int, body: bytes) -> bytes:
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def rsa_key(rng) -> bytes:
    numbers = [der(2, b"\x01" + rng.randbytes(64)) for _ in range(8)]
    return der(0x30, der(2, b"\0") + b"".join(numbers))


def test_structures():
    rng = random.Random(8)
    key = rsa_key(rng)
    pem = base64.encodebytes(key).decode()
    text = f"see\n-----BEGIN RSA PRIVATE KEY-----\n{pem}-----END RSA PRIVATE KEY-----\n"
    start, end = text.index(pem), text.index(pem) + len(pem) - 1
    assert ("key", start, end) in secrets.find_spans(text)
    one = base64.b64encode(key).decode()
    assert ("key", 2, 2 + len(one)) in secrets.find_spans(f"x {one} y")
    assert ("key", 0, 2 * len(key)) in secrets.find_spans(key.hex() + " z")
    broken = bytearray(key)
    broken[8] ^= 0x40  # the length of a nested number
    assert not [s for s in secrets.find_spans(base64.b64encode(bytes(broken)).decode()) if s[0] == "key"]

    def part(value) -> str:
        return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")

    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 1})}.c2lnbmF0dXJl"
    assert secrets.find_spans(f"é {token}") == [("jwt", 2, 2 + len(token))]
    assert secrets.find_spans(f"{part({'typ': 'JWT'})}.{part({'sub': 1})}.c2ln") == []
    spans = secrets.find_spans(f"token={token} AKIA{'B' * 16}")
    assert [s[0] for s in spans] == ["assign", "jwt", "access"]
    assert secrets.redact("a bcd e", [("hex", 2, 4), ("key", 3, 5)]) == f"a {secrets.REDACTED} e"


def test_base_patterns_consume_what_fails():
    assert secrets.find_spans("token=token:abcdef") == []
    assert secrets.find_spans("PassWD : 'abcdef'") == [("assign", 0, 16)]
    assert secrets.find_spans("ſecret=abcdefg") == []
    assert secrets.find_spans("a" * 23) == [] and secrets.find_spans("é" + "a" * 24) == [("hex", 1, 25)]


def test_op8(spark, sf_dir):
    import re

    sf_dir = sf_dir.replace("0.001", "0.01")
    texts = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()

    kinds = {
        "assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"(AKIA[A-Z0-9]+)",
        "hex": r"([0-9a-f]+)",
    }
    least = {"assign": 6, "access": 20, "hex": 24}
    found = {r.doc_id: r for r in QUERIES["op8_secrets"](spark, sf_dir).collect()}
    some = 0
    for doc, text in texts:
        spans = [
            (m.start(), i, f"{kind}:{m.start()}:{m.end()}")
            for i, (kind, pattern) in enumerate(kinds.items())
            for m in re.finditer(pattern, text or "")
            if len(m.group(1)) >= least[kind]
        ]
        line = ",".join(s[2] for s in sorted(spans))
        r = found[doc]
        assert r.base_sha256 == plain.sha(line)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == i for s in spans) for i in range(3))
        assert set(line.split(",")) <= set(r.spans.split(","))
        some += bool(spans)
    assert some


def test_op9(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    data = duckdb.sql(f"select vec_id, embedding from '{big}/embeddings.parquet' order by vec_id").fetchall()
    ids = [r[0] for r in data]
    unit = neighbours.unit(np.array([r[1] for r in data], dtype=float))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = plain.union(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(near)))])
    want = {v: (int(near[i].sum()), root[v], root[v] == v) for i, v in enumerate(ids)}
    found = {r[0]: r[1:] for r in rows(spark, "op9_neighbours", big)}
    assert set(found) == set(want)
    assert sum(r[0] for r in found.values()) >= 0.99 * sum(r[0] for r in want.values())
    assert np.mean([found[v] == want[v] for v in ids]) >= 0.99


def test_links_of_a_loose_chain(spark):
    """No centre is near to all of a chain, so its members are compared."""
    angles = [0.2 * i for i in range(12)]
    data = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    found = {r[0]: tuple(r[1:3]) for r in neighbours.link_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()}
    assert found == {i: (1 if i in (0, 11) else 2, 0) for i in range(12)}


def test_op10(spark, sf_dir, texts):
    assert sorted(rows(spark, "op10_minhash", sf_dir)) == sorted(plain.near_duplicates(texts))


def test_near_duplicate_links_at_the_threshold(spark):
    rng = random.Random(10)
    data = []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            data.append((len(data) * 7 % 1009, " ".join(copy)))
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(table).collect())
    assert got == sorted(plain.near_duplicates(data))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1040)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    rng.shuffle(links)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == plain.union(nodes, links)


def test_pipeline(spark, sf_dir, documents):
    """Each stage against brute force on what the one before it kept."""
    import corpus_pipeline
    from sidforge.llm.common import table
    from sidforge.session import materialize

    docs = table(spark, sf_dir, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, sf_dir), name)
        texts = [(r.doc_id, r.text) for r in before.collect()]
        if name == "language":
            kept = {r.doc_id for r in after.collect()}
            assert kept <= {d for d, _ in texts} and len(kept) >= 0.97 * len(texts)
        elif name == "near_duplicates":
            want = {r[0] for r in plain.near_duplicates(texts, 5) if r[3]}
            assert {r.doc_id for r in after.collect()} == want
        elif name == "secrets":
            got = {r.doc_id: r for r in after.collect()}
            for d, t in texts:
                assert got[d].text == secrets.redact(t, secrets.find_spans(t)) and got[d].n_chars == len(got[d].text)
        elif name == "mixing":
            counts: dict = {}
            for r in after.collect():
                counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
            plan = {r.doc_id: r for r in mixing.mix(before.select("doc_id", "source", mixing.token_count("text").alias("size"))).collect()}
            assert counts == {d: r.taken // r.size for d, r in plan.items() if r.taken}
        else:
            assert after.count() == before.count() and after.where("not round_trip").count() == 0
        before = after
