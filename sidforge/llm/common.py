"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.session import discard, materialize

# Rows of a batch are worked on in groups of about this many characters, so that the
# arrays of a task do not grow with the batch.
GROUP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(key: str, modulus: int) -> Column:
    """CRC-32 of the key as text, modulo; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % modulus


def text_groups(
    batches: Iterator[pa.RecordBatch], text: str = "text", chars: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold about ``chars`` (GROUP_CHARS) bytes.

    Texts are never cut: one that is longer forms a piece of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes.astype(np.int64)) // (chars or GROUP_CHARS)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def schema_of(rows: DataFrame) -> str:
    """The columns of ``rows`` as DDL, to put new ones behind."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results have been written.

    They go once the driver's JVM has collected the plans that made them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def python_texts(column: pa.Array) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


# --- words ----------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"  # the bytes 0x20 and 0x09-0x0D
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 5
_KEY = b"words of documents"
_SIP_KEY = np.frombuffer(hashlib.blake2b(_KEY, digest_size=16).digest(), "<u8")
_SIP_BYTES = 40  # words beyond are hashed one by one
_SIP_WORDS = 1 << 14  # words hashed at one time, so that the state stays in a core's cache
_BREAK = re.compile(b"[" + WHITE.encode() + b"]")
_IS_WHITE = np.isin(np.arange(256), list(WHITE.encode()))
_TAIL = (np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1)


def _word_hash(word: bytes) -> int:
    """64 bits of a keyed cryptographic hash."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    high = x << np.uint64(bits)
    high |= x >> np.uint64(64 - bits)
    return high


def _sip_rounds(v: list[np.ndarray], count: int) -> None:
    for _ in range(count):
        v[0] += v[1]
        v[2] += v[3]
        v[1], v[3] = _turn(v[1], 13), _turn(v[3], 16)
        v[1] ^= v[0]
        v[3] ^= v[2]
        v[0] = _turn(v[0], 32)
        v[2] += v[1]
        v[0] += v[3]
        v[1], v[3] = _turn(v[1], 17), _turn(v[3], 21)
        v[1] ^= v[2]
        v[3] ^= v[0]
        v[2] = _turn(v[2], 32)


def siphash(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: np.ndarray = _SIP_KEY) -> np.ndarray:
    """SipHash-2-4 of the byte strings at ``starts``; 8 readable bytes follow the last one."""
    loads = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(starts)
    k0, k1 = key
    begin = (k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573)
    v = [np.full(n, x, np.uint64) for x in begin]
    full = sizes >> 3
    for block in range(int(full.max(initial=-1)) + 1):
        at = np.flatnonzero(full >= block) if block else slice(None)
        m = loads[starts[at] + 8 * block]
        last = full[at] == block
        own = sizes[at][last]
        m[last] = (m[last] & _TAIL[own & 7]) | (own.astype(np.uint64) << np.uint64(56))
        state = [x[at] for x in v]
        state[3] ^= m
        _sip_rounds(state, 2)
        state[0] ^= m
        for x, new in zip(v, state):
            x[at] = new
    v[2] ^= np.uint64(0xFF)
    _sip_rounds(v, 4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def _spans(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about GROUP_CHARS bytes, cut at white space."""
    start = 0
    while len(data) - start > GROUP_CHARS and (gap := _BREAK.search(data, start + GROUP_CHARS)):
        yield start, gap.start()
        start = gap.start()
    if start < len(data):
        yield start, len(data)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words between ASCII white space, as hashes.

    Returns the offsets of each row's words and one 64-bit keyed hash per word: no two words are
    known to share them. A null text has no words.
    """
    column = texts.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    none = np.zeros(0, np.uint64)
    _, ends, body = column.buffers()
    if not len(column) or body is None:
        return np.zeros(len(column) + 1, np.int64), none
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]
    rows = ends - ends[0]
    places, parts = [np.zeros(0, np.int64)], [none]
    for low, high in _spans(data):
        padded = np.zeros(high - low + 8, np.uint8)
        padded[:-8] = data[low:high]
        white = _IS_WHITE[padded[:-8]]
        gap = np.ones(high - low + 1, bool)  # between a byte and the one before
        gap[1:-1] = white[:-1]
        gap[rows[np.searchsorted(rows, low) : np.searchsorted(rows, high)] - low] = True
        stop = gap.copy()
        stop[:-1] |= white
        starts = np.flatnonzero(~white & gap[:-1])
        sizes = np.flatnonzero(~white & stop[1:]) + 1 - starts
        long = np.flatnonzero(sizes > _SIP_BYTES)
        short = sizes.copy()
        short[long] = 0
        hashes = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), _SIP_WORDS):
            cut = slice(i, i + _SIP_WORDS)
            hashes[cut] = siphash(padded, starts[cut], short[cut])
        for i in long:
            hashes[i] = _word_hash(padded[starts[i] : starts[i] + sizes[i]].tobytes())
        places.append(starts + low)
        parts.append(hashes)
    return np.searchsorted(np.concatenate(places), rows), np.concatenate(parts)


def window_hashes(words: np.ndarray, width: int, factor: int = _BASE) -> np.ndarray:
    """One hash for each ``width`` consecutive words, also across rows."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Sums of 1, 2, 4, ... words, doubled; those in the binary form of the width are put together.
    total, done, power, size = None, 0, words, 1
    while True:
        if width & size:
            part = power[done : done + n]
            total = part if total is None else total * np.uint64(pow(factor, size, 1 << 64)) + part
            done += size
        if done == width:
            return mix64(total)
        power = power[:-size] * np.uint64(pow(factor, size, 1 << 64)) + power[size:]
        size *= 2


# --- connected components ----------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b): root is the smallest node
    that links reach. Nodes of self-links or with null are left out.

    Each round hooks every node that has a smaller neighbour to the smallest one,
    follows the hooks once more and contracts the edges; only nodes without a smaller
    neighbour are left, at most half. Edges shrink, and nothing is collected.
    """
    edge = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    left = materialize(edges.where("a <> b").select(*edge).distinct(), "edges")
    nodes = left.select(F.col("lo").alias("node")).union(left.select("hi")).distinct()
    labels = materialize(nodes.withColumn("root", F.col("node")), "labels")
    while not left.isEmpty():
        hooks = left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up"))
        hooks = materialize(hooks, "hooks")
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = hooks.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("top"))
        jump = materialize(jump, "jump", replaces=hooks)
        labels = materialize(_follow(labels, "root", jump), "labels", replaces=labels)
        moved = _follow(_follow(left, "lo", jump), "hi", jump)
        moved = moved.where("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
        left = materialize(moved.distinct(), "edges", replaces=left)
        discard(jump)
    discard(left)
    return labels


def _follow(rows: DataFrame, column: str, jump: DataFrame) -> DataFrame:
    found = rows.join(jump.select(F.col("node").alias(column), "top"), column, "left")
    others = [c for c in rows.columns if c != column]
    return found.select(*others, F.coalesce("top", column).alias(column)).select(*rows.columns)
