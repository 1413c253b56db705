"""Removal of repeated passages by factoring documents against indexed reference blocks.

Words lie between ASCII white space. A window is WIDTH consecutive words; a window of a
document is repeated if its words also start in a document with a smaller id. All words under
repeated windows are removed.

Each window has an anchor, the smallest hash among its ANCHOR-word sequences, and neighbouring
windows with one anchor form a segment. Equal windows have equal anchors, so the reference
splits into blocks by anchor: a block indexes all segments with that anchor, and a document
has to be factored only against the blocks of its own anchors. The parse is greedy: a segment
that equals one of an earlier document is a factor as a whole. Where segments of a block
differ, factors end, and the windows there are looked up one by one. Together this decides every
window exactly, up to equal keyed hashes of 128 bits.

Anchors that occur in one document only are dropped after the first count, before anything
wider is shuffled. All look-ups are joins on hashed keys: a passage that a third of the
documents share is one key whose rows are counted before the shuffle and split in the join.

A null text has no words. Rows with equal ids are one document for the comparison and keep
their own results. A null id sorts behind all others.
"""

from __future__ import annotations

import hashlib
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidforge.llm.common import mix64, release, schema_of, text_groups, window_hashes, word_hashes
from sidforge.session import discard, materialize

WIDTH = 13
ANCHOR = 6
_LAST = (1 << 63) - 1  # stands for a null id
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SECOND = 0xD1342543DE82EF95  # factor of a second, independent hash of a window


class Windows:
    """The windows of a column of texts and the segments they form."""

    def __init__(self, texts: pa.Array, width: int, anchor: int):
        self.offsets, self.words = word_hashes(texts)
        self.width = width
        sizes = np.diff(self.offsets)
        row = np.repeat(np.arange(len(sizes)), sizes)
        # Windows that cross rows are left out.
        self.at = np.flatnonzero(row[: max(0, len(row) - width + 1)] == row[width - 1 :])
        self.row = row[self.at]
        best, place = _lowest(mix64(window_hashes(self.words, anchor)), width - anchor + 1)
        place = place[self.at]
        n = len(place)
        fresh = np.ones(n, bool)
        fresh[1:] = (place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1])
        self.first = np.flatnonzero(fresh)
        self.count = np.diff(np.append(self.first, n))
        self.segment_row = self.row[self.first]
        self.anchor = best[self.at[self.first]].view(np.int64)

    @cached_property
    def hash(self) -> np.ndarray:
        return window_hashes(self.words, self.width)[self.at].view(np.int64)

    @cached_property
    def check(self) -> np.ndarray:
        return window_hashes(self.words, self.width, _SECOND)[self.at].view(np.int64)

    @cached_property
    def segment(self) -> np.ndarray:
        windows = self.hash.view(np.uint64)
        both = mix64(windows[self.first] * _FACTOR + windows[self.first + self.count - 1])
        return mix64(both + self.count.astype(np.uint64)).view(np.int64)


def _lowest(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of each ``size`` consecutive values and the first place that holds it."""
    best, place, done = values, np.arange(len(values)), 1
    while done < size:
        step = min(done, size - done)
        left, right = best[: max(0, len(best) - step)], best[step:]
        lower = right < left
        best, place, done = np.where(lower, right, left), np.where(lower, place[step:], place[: len(left)]), done + step
    return best, place


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"), "text")


def segments(keyed: DataFrame, width: int, anchor: int, content: bool) -> DataFrame:
    """``(doc, anchor)`` or ``(doc, anchor, segment)`` of ``keyed`` (doc, text), each once
    per row."""

    def build(batches):
        for part in text_groups(batches):
            w = Windows(part.column("text"), width, anchor)
            doc = part.column("doc").to_numpy()[w.segment_row]
            arrays = {"doc": doc, "anchor": w.anchor} | ({"segment": w.segment} if content else {})
            # Equal rows are neighbours in the order of a mixed key; keys that happen to be equal
            # only leave a repeat.
            order = np.argsort(_mixed(w.segment_row, w.segment if content else w.anchor))
            fresh = np.ones(len(order), bool)
            if len(order):
                fresh[1:] = np.any([v[order[1:]] != v[order[:-1]] for v in arrays.values()], axis=0)
            kept = np.sort(order[fresh])
            yield pa.RecordBatch.from_pydict({k: pa.array(v[kept]) for k, v in arrays.items()})

    return keyed.mapInArrow(build, "doc bigint, anchor bigint" + ", segment bigint" * content)


def _listed(rows: DataFrame, value: str, name: str) -> DataFrame:
    return rows.groupBy("doc").agg(F.collect_set(value).alias(name))


def _boundary_windows(keyed: DataFrame, wanted: DataFrame, width: int, anchor: int) -> DataFrame:
    """``(doc, window, check)`` of the segments in ``wanted`` (doc, parts)."""

    def build(batches):
        for part in text_groups(batches):
            w = Windows(part.column("text"), width, anchor)
            lists = part.column("parts")
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            ours = _member(w.segment_row, w.segment, row, lists.flatten().to_numpy())
            chosen = np.repeat(ours, w.count)
            doc = part.column("doc").to_numpy()[w.row[chosen]]
            yield pa.RecordBatch.from_pydict(
                {"doc": pa.array(doc), "window": pa.array(w.hash[chosen]), "check": pa.array(w.check[chosen])}
            )

    rows = keyed.join(wanted, "doc").select("doc", "text", "parts")
    return rows.mapInArrow(build, "doc bigint, window bigint, check bigint").distinct()


def _mixed(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One key of a row and a hash."""
    return value.view(np.uint64) ^ mix64(row.astype(np.uint64) + _FACTOR)


def _member(row: np.ndarray, value: np.ndarray, set_row: np.ndarray, set_value: np.ndarray) -> np.ndarray:
    """Whether (row, value) is among (set_row, set_value)."""
    if not len(set_row):
        return np.zeros(len(row), bool)
    keys = _mixed(set_row, set_value)
    order = np.argsort(keys)
    place = np.minimum(np.searchsorted(keys[order], _mixed(row, value)), len(order) - 1)
    found = order[place]
    return (set_row[found] == row) & (set_value[found] == value)


def find_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """``(doc, parts, windows)``: per document the segments all of whose windows are
    repeated and the single windows that are. Documents without any are left out."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    # Blocks with one document hold no repeat.
    blocks = segments(keyed, width, anchor, False).groupBy("anchor")
    blocks = blocks.agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    blocks = materialize(blocks.select("anchor"), "blocks")
    release(spark)
    shared = segments(keyed, width, anchor, True).join(blocks, "anchor")
    shared = materialize(shared.select("doc", "anchor", "segment"), "segments")
    discard(blocks)
    release(spark)
    index = shared.groupBy("anchor", "segment").agg(F.min("doc").alias("first"))
    index = materialize(index, "index")
    same = ["anchor", "segment"]
    whole = shared.join(index, same).where("doc > first").select("doc", "segment")
    parts = materialize(_listed(whole, "segment", "parts"), "parts")
    release(spark)
    # Blocks whose segments differ: their windows, each from the segment's first document.
    mixed = index.groupBy("anchor").agg(F.min("segment").alias("lo"), F.max("segment").alias("hi"))
    mixed = mixed.where("lo < hi").select("anchor")
    edges = index.join(mixed, "anchor").select(F.col("first").alias("doc"), "segment")
    edges = materialize(_listed(edges, "segment", "parts"), "edges")
    single = materialize(_boundary_windows(keyed, edges, width, anchor), "windows")
    release(spark)
    seen = single.groupBy("window", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("high"))
    seen = seen.where("first < high").select("window", "check", "first")
    later = single.join(seen, ["window", "check"]).where("doc > first").select("doc", "window")
    windows = _listed(later, "window", "windows")
    return materialize(parts.join(windows, "doc", "full"), "repeats")


def repeated_words(w: Windows, parts: pa.Array, windows: pa.Array) -> np.ndarray:
    """Mask over all words of the column: those under repeated windows."""
    hit = np.zeros(len(w.hash), bool)
    for lists, row, value, spread in (
        (parts, w.segment_row, w.segment, True),
        (windows, w.row, w.hash, False),
    ):
        sizes = np.diff(lists.offsets.to_numpy())
        found = _member(row, value, np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy())
        hit |= np.repeat(found, w.count) if spread else found
    total = int(w.offsets[-1])
    begun = np.zeros(total + w.width, np.int64)
    begun[w.at[hit] + w.width] = 1
    begun = np.cumsum(begun)
    # A word is covered if a window begins at it or at one of the width - 1 words before.
    return begun[w.width :] > begun[:total]


def remove_repeats(docs: DataFrame, keep: list[str], width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """``keep`` with ``n_words``, ``n_removed`` and ``kept_text``, the other words joined by
    one space."""
    repeats = find_repeats(docs, width, anchor)

    def build(batches):
        for part in text_groups(batches):
            texts = part.column("text").cast(pa.large_binary())
            lists = [part.column("_parts"), part.column("_windows")]
            met = np.flatnonzero(sum(np.diff(v.offsets.to_numpy()) for v in lists))
            # Documents that repeat nothing need no windows.
            w = Windows(texts.take(pa.array(met)), width, anchor)
            gone = repeated_words(w, *(v.take(pa.array(met)) for v in lists))
            place = dict(zip(met.tolist(), range(len(met))))
            kept, counts, removed = [], [], []
            for i, text in enumerate(texts):
                words = (text.as_py() or b"").split()  # of bytes: ASCII white space
                counts.append(len(words))
                if i in place:
                    own = gone[w.offsets[place[i]] : w.offsets[place[i] + 1]]
                    words = list(compress(words, (~own).tolist()))
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*keep, "n_words", "n_removed", "kept_text"],
            )

    def or_none(name: str) -> Column:
        return F.coalesce(F.col(f"r.{name}"), F.array().cast("array<bigint>")).alias(f"_{name}")

    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))
    chosen = docs.select(*dict.fromkeys([*keep, "text"]), key.alias("_doc"))
    met = chosen.alias("d").join(repeats.alias("r"), F.expr("d._doc = r.doc"), "left")
    rows = met.select(*(F.col(f"d.`{c}`") for c in chosen.columns), or_none("parts"), or_none("windows"))
    schema = f"{schema_of(docs.select(*keep))}, n_words bigint, n_removed bigint, kept_text string"
    return rows.mapInArrow(build, schema)


def kept_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
