"""Words and their hashes: no two words meet, whatever their letters."""

import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from sidforge.llm import common, minhash, repeats


def thue_morse(size):
    """The word and its complement: equal under any polynomial modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_are_those_between_ascii_white_space(monkeypatch):
    monkeypatch.setattr(common, "GROUP_CHARS", 40)
    rng = random.Random(1)
    letters = "abé一\U0001f600\u0085  \t\n\x0b\x0c\r\x1c"
    texts = [None, "", " \n", "x" * 500] + ["".join(rng.choices(letters, k=rng.randrange(300))) for _ in range(200)]
    offsets, hashes = common.word_hashes(pa.array(texts, pa.string()))
    found = {}
    for text, start, end in zip(texts, offsets, offsets[1:]):
        words = plain.words(text)
        assert end - start == len(words)
        for word, value in zip(words, hashes[start:end].tolist()):
            assert found.setdefault(word, value) == value
    assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("size", [1024, 4096])
def test_thue_morse_words_differ(spark, size):
    one, other = thue_morse(size)
    offsets, hashes = common.word_hashes(pa.array([f"{one} {other}"]))
    assert len(np.unique(hashes)) == 2
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, one), (4, other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = repeats.remove_repeats(docs, ["doc_id"]).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, repeats.kept_digest(r.kept_text)) for r in kept)
    assert got == plain.repeats(rows)
    near = minhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, near)) == plain.near_duplicates(rows)


def test_long_random_words(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("ab", k=rng.choice((63, 64, 2048, 5000)))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(12)]
    rows += [(100 + i, " ".join(t.split()[: 20 + i]) + " end") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = repeats.remove_repeats(docs, ["doc_id"]).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, repeats.kept_digest(r.kept_text)) for r in kept)
    assert got == sorted(plain.repeats(rows))
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == sorted(plain.near_duplicates(rows))


def test_siphash_gives_the_published_values():
    key = np.frombuffer(bytes(range(16)), "<u8")
    data = np.frombuffer(bytes(range(15)) + bytes(8), np.uint8)
    got = common.siphash(data, np.zeros(4, np.int64), np.array([0, 1, 8, 15]), key)
    assert [hex(x) for x in got.tolist()] == ["0x726fdb47dd0e0e31", "0x74f839c593dc67fd", "0x93f5f5799a932462", "0xa129ca6149be45e5"]


def test_short_words_are_not_hashed_one_by_one(monkeypatch):
    seen = []
    one = common._word_hash
    monkeypatch.setattr(common, "_word_hash", lambda word: seen.append(word) or one(word))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=k)) for k in range(6, 46) for _ in range(50)]
    column = pa.array([" ".join(words), None, "\t".join(words), "a" * 41]).slice(0, 4)
    offsets, hashes = common.word_hashes(column)
    assert offsets.tolist() == [0, len(words), len(words), 2 * len(words), 2 * len(words) + 1]
    assert len(np.unique(hashes)) == len(set(words)) + 1
    assert all(len(word) > 40 for word in seen)
    assert np.array_equal(common.word_hashes(column.slice(2, 1))[1], hashes[: len(words)])


def test_repeats_among_documents_with_and_without_any(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = [(i, " \t".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(30)]
    rows += [(30 + i, f"{' '.join(rng.choices(vocabulary, k=i))} {passage}\n{passage} end") for i in range(15)]
    rows += [(50, None), (51, "é " * 40), (52, "é " * 26)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = repeats.remove_repeats(docs, ["doc_id"]).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, repeats.kept_digest(r.kept_text)) for r in kept)
    assert got == sorted(plain.repeats(rows))
