"""Text to vector.

The encoder is a plug-in: ``factory()`` runs once per task and returns a
function from a list of texts to a matrix. The built-in encoder counts hashed
words.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.operators import kernels as k
from sidforge.operators.quantize import _arrow_map, _column

# Default texts per encoder call and default vector width.
BATCH_TEXTS = 256
EMBED_DIM = 1536
WORD_BREAK = r"[ \t\r\n\f]+"


def word_buckets(words: list[str], dim: int) -> np.ndarray:
    """Bucket of every word: the first 32 bits of its md5, modulo ``dim``."""
    heads = (md5(w.encode(), usedforsecurity=False).hexdigest()[:8] for w in words)
    return np.array([int(h, 16) % dim for h in heads], dtype=np.int64)


def word_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Words per bucket of each text. A distinct word is hashed once per batch."""
    lists = pc.split_pattern_regex(texts, WORD_BREAK)
    widths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), widths)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    place = coded.indices.to_numpy(zero_copy_only=False)
    # Splitting leaves empty words at the ends of a text.
    real = np.array([w != "" for w in words], dtype=np.float64)
    cell = row * dim + word_buckets(words, dim)[place]
    return np.bincount(cell, real[place], len(lists) * dim).reshape(len(lists), dim)


def embed_text(
    df: DataFrame,
    text: str,
    dim: int = EMBED_DIM,
    factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    batch: int = BATCH_TEXTS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``embedding array<float>`` of each whole text.

    Without a factory: word counts per bucket, scaled to unit length (a text
    without words stays zero). The counts are taken inside the row, so no
    word is shuffled.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    added = [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if factory is None:

        def count_words(piece):
            matrix = word_counts(_column(piece, "_text"), dim)
            length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            matrix /= np.where(length == 0, 1.0, length)
            return {"embedding": k.to_lists(matrix.astype(np.float32), pa.float32())}

        return _arrow_map(source, [*keep, "_text"], added, count_words, keep)

    schema = T.StructType([source.schema[c] for c in keep] + added)

    def encode(tables):
        model = factory()
        for table in tables:
            for start in range(0, table.num_rows, batch):
                piece = table.slice(start, batch)
                vectors = np.asarray(model(_column(piece, "_text").to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays(
                    [_column(piece, c) for c in keep] + [k.to_lists(vectors, pa.float32())],
                    names=[*keep, "embedding"],
                )

    return source.mapInArrow(encode, schema)
