"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1. A trigram binds its three letters: the
first vector shifted twice, the second shifted once and the third are multiplied. A text
is the sum (bundle) of its trigram vectors, a language the sum of the texts that carry its
label, and a text belongs to the language whose prototype has the largest cosine.

Letters are lower-cased; anything between two runs of letters counts as one space. A null
text, a text without letters and a model without languages give ``und`` with score 0. Equal
cosines go to the smaller language code. A null label teaches nothing; a null id is not held
out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.llm.common import python_texts, schema_of, text_groups

DIMENSIONS = 1024
UNKNOWN = "und"
TRAIN_ROWS = 5000  # labelled texts of one language, on average
_POINTS = 0x110000  # code points
_TABLE = 1 << 22  # trigrams that a table numbers; more are sorted
_BLOCK = 4096  # trigrams whose vectors exist at one time
_ROWS = 256  # texts counted at one time
_CHARS = 500_000  # and their characters, about; each takes some 60 bytes meanwhile


@lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    """+1 or -1 for each dimension, the same in every process."""
    return np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors, one row for each row of three code points."""
    bound = np.ones((len(codes), DIMENSIONS), np.int8)
    for place in range(3):
        letters, index = np.unique(codes[:, place], return_inverse=True)
        bound *= np.stack([np.roll(letter_vector(int(c)), 2 - place) for c in letters])[index]
    return bound


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(_POINTS)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text and the three code points of every trigram."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    letter = _alphabet()[codes]
    # Of the characters between two runs of letters one stays, as a space.
    stays = letter.copy()
    stays[0] = True
    stays[1:] |= letter[:-1] | (row[1:] != row[:-1])
    codes, row = np.where(letter, codes, ord(" "))[stays], row[stays]
    whole = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
    # Text without letters is a space or two.
    return row[whole], np.stack([codes[whole], codes[whole + 1], codes[whole + 2]], axis=1)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams and the place of each trigram among them."""
    letters = np.zeros(_POINTS, bool)
    letters[codes.ravel()] = True
    names = np.flatnonzero(letters)
    number = np.zeros(_POINTS, np.int64)
    number[names] = np.arange(len(names))
    a, b, c = number[codes].T
    packed = (a * len(names) + b) * len(names) + c
    if len(names) ** 3 <= _TABLE:
        used = np.zeros(len(names) ** 3, bool)
        used[packed] = True
        found = np.flatnonzero(used)
        place = np.zeros(len(used), np.int64)
        place[found] = np.arange(len(found))
        index = place[packed]
    else:
        found, index = np.unique(packed, return_inverse=True)
    split = np.stack([found // len(names) ** 2, found // len(names) % len(names), found % len(names)], axis=1)
    return names[split], index


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of exact integers for each text, zero without letters, and its evidence.

    The evidence is the number of trigrams that count: the square of all over the sum of the
    squares of each one's occurrences. It is the number of trigrams if none repeats, and that
    of one copy if a text repeats itself.
    """
    out = np.zeros((len(texts), DIMENSIONS))
    total, squares = np.zeros(len(texts)), np.zeros(len(texts))
    row, codes = trigrams(texts)
    if not len(row):
        return out, total
    names, index = _distinct(codes)
    # Single precision holds the sums of shorter texts exactly and is faster.
    exact = np.float32 if np.bincount(row).max() < 1 << 24 else np.float64
    for start in range(0, len(names), _BLOCK):
        block = names[start : start + _BLOCK]
        here = slice(None) if len(names) <= _BLOCK else (index >= start) & (index < start + _BLOCK)
        cells = row[here] * len(block) + (index[here] - start)
        counts = np.bincount(cells, minlength=len(texts) * len(block)).reshape(len(texts), -1)
        out += counts.astype(exact) @ trigram_vectors(block).astype(exact)
        total += counts.sum(axis=1)
        squares += np.einsum("ij,ij->i", counts, counts, dtype=np.float64)
    return out, total**2 / np.maximum(squares, 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for piece in text_groups(batches, chars=_CHARS):
        for start in range(0, piece.num_rows, _ROWS):
            part = piece.slice(start, _ROWS)
            yield part, *bundles(python_texts(part.column("text")))


def learn_prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Bundle texts of each language in ``labelled`` (doc_id, text, lang).

    Of a language with more than TRAIN_ROWS labelled texts a hash of the id draws about as many.

    Each task adds up its rows; one vector per task and language is shuffled. Only the
    prototypes reach the driver, one vector of DIMENSIONS numbers for each language. The
    sums are of integers, so the order of rows does not matter.
    """

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for part, vectors, _ in _chunks(batches):
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                chosen = vectors[[x == lang for x in langs]].sum(axis=0)
                sums[lang] = sums.get(lang, 0) + chosen
        for lang in sorted(sums):
            yield pa.RecordBatch.from_pydict({"lang": [lang], "v": [sums[lang].tolist()]})

    rows = labelled.where("lang is not null and text is not null")
    # One row per language.
    shares = rows.groupBy("lang").agg((F.lit(TRAIN_ROWS) / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    rows = rows.join(F.broadcast(shares), "lang").where(drawn)
    parts = rows.select("text", "lang").mapInArrow(partial, "lang string, v array<double>")
    cells = parts.select("lang", F.posexplode("v").alias("i", "x"))
    sums = cells.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: np.array([c["x"] for c in r["v"]]) for r in whole.sort("lang").collect()}


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], evidence: str | None = None
) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score``, the cosine cut to 0..1, and the number of
    trigrams that count in a column named by ``evidence``."""
    more = [evidence] if evidence else []
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)

    def score(batches):
        for part, vectors, weight in _chunks(batches):
            size = np.linalg.norm(vectors, axis=1)
            best, cosine = np.zeros(len(size), np.int64), np.zeros(len(size))
            if names:
                cosines = (vectors @ matrix.T) / np.maximum(size, 1e-300)[:, None]
                best = cosines.argmax(axis=1)
                cosine = np.clip(cosines.max(axis=1), 0.0, 1.0)
            known = (size > 0) & bool(names)
            langs = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
            columns = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(np.where(known, cosine, 0.0)), *(pa.array(weight) for _ in more)],
                names=[*keep, "lang_pred", "score", *more],
            )

    kept = schema_of(docs.select(*keep))
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    extra = "".join(f", `{c}` double" for c in more)
    return rows.mapInArrow(score, f"{kept}, lang_pred string, score double{extra}")
