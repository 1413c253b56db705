"""Byte-level BPE encoding and decoding.

A text is cut into words by the tokenizer's pattern. The bytes of a distinct word are an array
of pieces; each step of a fold joins the leftmost pair of neighbours whose joined bytes have
the lowest rank, until no pair has a rank. Encodings are kept per worker for later texts, at
most twice CACHED_WORDS of them. Decoding looks up the bytes of each id and joins them.

The fold runs in Arrow batches with the rank map as a broadcast dictionary of fixed size (one
entry per line of the vocabulary file). As Spark higher-order functions over a literal map it
takes 25 times the time allowed, because such a map is searched from end to end and every step
is interpreted; README has the figures. No row is shuffled.

Special tokens are ordinary text. A null text counts as empty and has no ids. A byte that is
not in the vocabulary and an id outside it stop the job.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from sidforge.llm.common import python_texts, schema_of, text_groups

CACHED_WORDS = 150_000  # of a generation; a worker keeps two, about 50 MB, and they outlive a task
CACHED_CHARS = 64  # longer words are not kept
_NONE = 1 << 62
_LONG = 48  # bytes from which a heap finds the lowest rank
_LONG_TEXT = 4_000_000  # characters from which words are not listed all at once

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """The ranks in a file of base64 pieces and numbers, which is read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """One copy of the vocabulary for each executor; its size does not depend on the data."""
    return spark.sparkContext.broadcast(read_ranks(path))


def _rank_of(piece: bytes, ranks: Ranks) -> int:
    if piece not in ranks:
        raise ValueError(f"byte {piece!r} is not in the vocabulary")
    return ranks[piece]


def fold_merges(word: bytes, ranks: Ranks) -> tuple[int, ...]:
    """The ids of one word."""
    if word in ranks:
        return (ranks[word],)
    if len(word) >= _LONG:
        return _fold_long(word, ranks)
    # Where pieces start, and the rank of each piece joined with the next one.
    starts = list(range(len(word) + 1))
    get = ranks.get
    found = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while found and (best := min(found)) != _NONE:
        at = found.index(best)
        del starts[at + 1], found[at]
        if at < len(found):
            found[at] = get(word[starts[at] : starts[at + 2]], _NONE)
        if at:
            found[at - 1] = get(word[starts[at - 1] : starts[at + 1]], _NONE)
    return tuple(_rank_of(word[i:j], ranks) for i, j in zip(starts, starts[1:]))


def _fold_long(word: bytes, ranks: Ranks) -> tuple[int, ...]:
    """The same fold; a heap of ranked pairs keeps a long word from taking its square."""
    size = len(word)
    end = list(range(1, size + 1))  # of the piece that starts here
    before = list(range(-1, size - 1))  # start of the piece in front
    alive = [True] * size
    pairs: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and end[at] < size:
            stop = end[end[at]]
            rank = ranks.get(word[at:stop])
            if rank is not None:
                heapq.heappush(pairs, (rank, at, stop))

    for at in range(size - 1):
        offer(at)
    while pairs:
        _, at, stop = heapq.heappop(pairs)
        if not alive[at] or end[at] >= size or end[end[at]] != stop:
            continue  # one of the two has been joined since
        alive[end[at]] = False
        end[at] = stop
        if stop < size:
            before[stop] = at
        offer(at)
        offer(before[at])
    return tuple(_rank_of(word[i : end[i]], ranks) for i in range(size) if alive[i])


def latin_pattern(pattern: str) -> str:
    """``pattern`` for ``re``, which is faster: classes that only ``regex`` knows are written
    out, and match the same as long as no character is above U+00FF."""
    parts, inside, at = [], False, 0
    while at < len(pattern):
        found = regex.match(r"\\p\{\w+\}|\\[sS]|\\.|.", pattern[at:], regex.DOTALL)
        part = found.group()
        if part == "[" or part == "]":
            inside = part == "["
        elif part[:2] in ("\\p", "\\s", "\\S"):
            members = "".join(f"\\x{c:02x}" for c in range(256) if regex.match(part, chr(c)))
            part = members if inside else f"[{members}]"
        parts.append(part)
        at += found.end()
    return "".join(parts)


def _is_latin(text: str) -> bool:
    """Whether no character is above U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Encodes texts and keeps the ids of words it has met lately.

    When a generation is full it becomes the older one; words that are met again return from
    there, all others go with it.
    """

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.latin = re.compile(latin_pattern(pattern))
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _words(self, text: str) -> Iterator[list[str]]:
        pattern = self.latin if _is_latin(text) else self.pattern
        if len(text) < _LONG_TEXT:
            yield pattern.findall(text)
            return
        matches = (m.group() for m in pattern.finditer(text))
        while part := list(itertools.islice(matches, 100_000)):
            yield part

    def _ids(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word) or fold_merges(word.encode(), self.ranks)
        if len(word) <= CACHED_CHARS:
            if len(self.known) >= CACHED_WORDS:
                self.older = self.known
                self.known = {}
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        fold, out = self._ids, []
        for part in self._words(text):
            known = self.known  # a generation that ends meanwhile is still right
            out.extend(itertools.chain.from_iterable([known.get(w) or fold(w) for w in part]))
        return out


class Decoder:
    def __init__(self, ranks: Ranks):
        self.pieces = {i: piece for piece, i in ranks.items()}

    def decode(self, ids: list[int]) -> bytes:
        try:
            return b"".join([self.pieces[i] for i in ids])
        except KeyError as unknown:
            raise ValueError(f"id {unknown} is not in the vocabulary") from None


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks: Broadcast, pattern: str) -> Encoder:
    """The encoder of this worker process; workers serve many tasks."""
    key = (id(ranks.value), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks.value, pattern)
    return _ENCODERS[key]


def _map_texts(docs: DataFrame, keep: list[str], added: str, work: Callable) -> DataFrame:
    """``keep`` and new columns that ``work`` makes from the texts of a batch."""

    def run(batches):
        use = work()
        for part in text_groups(batches):
            arrays = use(python_texts(part.column("text")))
            columns = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, *arrays.values()], names=[*keep, *arrays])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(run, f"{schema_of(docs.select(*keep))}, {added}")


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``ids array<int>``."""

    def work():
        encoder = _encoder(ranks, pattern)
        return lambda texts: {"ids": pa.array([encoder.encode(t) for t in texts], pa.list_(pa.int32()))}

    return _map_texts(docs, keep, "ids array<int>", work)


def decode(rows: DataFrame, ranks: Broadcast, keep: list[str]) -> DataFrame:
    """``keep`` with ``decoded binary``, from ``ids``; null where ``ids`` is null."""

    def run(batches):
        decoder = Decoder(ranks.value)
        for batch in batches:
            found = [None if ids is None else decoder.decode(ids) for ids in batch.column("ids").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=[*keep, "decoded"])

    chosen = rows.select(*dict.fromkeys([*keep, "ids"]))
    return chosen.mapInArrow(run, f"{schema_of(rows.select(*keep))}, decoded binary")


def round_trip(docs: DataFrame, ranks: Broadcast, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: every text encoded,
    and its ids decoded again, where it lies."""

    def work():
        encoder, decoder = _encoder(ranks, pattern), Decoder(ranks.value)
        shown = {i: str(i) for i in decoder.pieces}

        def digests(texts: list[str]) -> dict[str, pa.Array]:
            counts, coded, decoded = [], [], []
            for text in texts:
                ids = encoder.encode(text)
                counts.append(len(ids))
                coded.append(hashlib.sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            return {
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(coded, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }

        return digests

    return _map_texts(docs, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)
