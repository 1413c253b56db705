"""Quality classifier from compressed sizes.

Two zstandard dictionaries are built, one from texts labelled good, one from texts
labelled bad. A text is compressed with each; the difference of the two sizes over the size
of the text, in a logistic curve, is the score. Texts are compressed in pieces of PIECE
bytes, each against the whole dictionary, so the difference means the same in long texts.

Learning reads a bounded sample: per class the SAMPLE_ROWS texts of at most SAMPLE_CHARS
characters with the smallest hash. Half of them fill the dictionaries, the other half fits
the curve. Scoring reads every text to its end.

A null text counts as empty; the empty text has difference 0 and gets the curve's value
there. Without two texts of either class every score is the share of good labels (0.5
without any). Labels other than 0 and 1, null included, teach nothing, and neither do rows
without id; repeated rows teach once.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.llm.common import python_texts, schema_of, text_groups
from sidforge.session import discard, materialize

SAMPLE_ROWS = 2000
SAMPLE_CHARS = 100_000
DICTIONARY_BYTES = 1 << 19
PIECE = 2048
LEVEL = 9
CUTOFF = 0.3
_SHARE = 256  # bytes that one text gives to a dictionary at a time


@dataclass(frozen=True)
class Model:
    """Dictionary contents and the logistic curve over the size difference."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


def dictionary(texts: list[bytes]) -> bytes:
    """Excerpts of the texts in turn, up to DICTIONARY_BYTES."""
    parts, size, start = [], 0, 0
    longest = max(map(len, texts), default=0)
    while size < DICTIONARY_BYTES and start < longest:
        for text in texts:
            part = text[start : start + _SHARE]
            parts.append(part)
            size += len(part)
            if size >= DICTIONARY_BYTES:
                break
        start += _SHARE
    return b"".join(parts)[:DICTIONARY_BYTES]


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    prepared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=prepared, write_content_size=False, write_checksum=False)


def _size(data: bytes, content: bytes) -> int:
    compress = _compressor(content).compress
    return sum(len(compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE))


def difference(data: bytes, good: bytes, bad: bytes) -> float:
    """Bytes saved by the good dictionary over the bad one, per byte of text."""
    return (_size(data, bad) - _size(data, good)) / len(data) if data else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    weights = np.zeros(2)
    ridge = np.diag([1e-6, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (p - y) + ridge @ weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge
        move = np.linalg.solve(curve, slope)
        weights = weights - np.clip(move, -50, 50)
        if np.abs(move).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


def draw(docs: DataFrame, labels: DataFrame) -> dict[int, list[bytes]]:
    """The sampled texts of each class, in the order of their hashes.

    Texts stay in their tasks until the sample is known: only ids and hashes are joined with
    the labels, and the ids drawn, at most SAMPLE_ROWS per class, are broadcast to the texts.
    """
    key = F.xxhash64(F.lit(20240501), "doc_id", "text").alias("k")
    fitting = docs.where(f"length(text) between 1 and {SAMPLE_CHARS}").select("doc_id", key, "text")
    marked = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    pairs = materialize(fitting.select("doc_id", "k").distinct().join(marked, "doc_id"), "labelled")
    chosen = pairs.limit(0)
    for quality, count in pairs.groupBy("quality").count().collect():
        # Twice the rows that are wanted lie below this hash, so few leave each task.
        share = min(1.0, 2 * SAMPLE_ROWS / count)
        below = min(int((share - 0.5) * 2**64), 2**63 - 1)
        one = pairs.where((F.col("quality") == quality) & (F.col("k") <= below))
        chosen = chosen.unionByName(one.sort("k", "doc_id").limit(SAMPLE_ROWS))
    found = fitting.join(F.broadcast(chosen), ["doc_id", "k"])
    # Repeated rows teach once.
    once = found.groupBy("quality", "k", "doc_id").agg(F.min("text").alias("text"))
    rows = sorted(once.collect(), key=lambda r: (r["k"], r["doc_id"]))
    discard(pairs)
    return {q: [r["text"].encode() for r in rows if r["quality"] == q] for q in (0, 1)}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, quality)."""
    drawn = draw(docs, labels)
    if not (len(drawn[0]) > 1 and len(drawn[1]) > 1):
        count = len(drawn[0]) + len(drawn[1])
        share = np.clip(len(drawn[1]) / count if count else 0.5, 0.01, 0.99)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    good, bad = (dictionary(drawn[q][0::2]) for q in (1, 0))
    x = [difference(t, good, bad) for q in (0, 1) for t in drawn[q][1::2]]
    y = [float(q) for q in (0, 1) for _ in drawn[q][1::2]]
    return Model(good, bad, *fit_curve(np.array(x), np.array(y)))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` with ``score``, higher where a text is likelier good."""

    def rate(batches):
        for part in text_groups(batches):
            texts = (t.encode() for t in python_texts(part.column("text")))
            x = np.array([difference(t, model.good, model.bad) if model.good else 0.0 for t in texts])
            rated = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            columns = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rated)], names=[*keep, "score"])

    kept = schema_of(docs.select(*keep))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(rate, f"{kept}, score double")
