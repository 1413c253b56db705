"""Near-duplicates by b-bit MinHash.

A document's set are its distinct shingles of SHINGLE words; ASCII capitals are lowered, words
lie between ASCII white space, and a shorter document is one shingle. BANDS * ROWS minima are
taken over the set. Full minima give the band keys; the low SIGNATURE_BITS of each are packed
into a signature. Documents that share a band key are candidates; their similarity is
estimated from equal signature fields, corrected for fields that are equal by chance, and
pairs whose estimate is not far below the threshold are confirmed on the full sets.

At the threshold a pair misses all bands with probability (1 - 0.8^4)^32, about 5e-8, and the
estimate lies MARGIN deviations too low with less.

Equal sets are one class from the start. In a first pass each class of a bucket meets the
bucket's smallest id, which finds most components without listing pairs. Buckets that still
hold several components are searched completely: signatures of different components are
compared inside tasks of bounded size, and again only confirmed pairs link.

Rows with equal ids count as one document (its rows are linked). A document without words and
a row without id link with nothing; the latter has no component and is kept. An empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.llm.common import components, mix64, release, text_groups, window_hashes, word_hashes
from sidforge.session import discard, materialize

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SIGNATURE_BITS = 4
MARGIN = 6.0
BLOCK = 2048  # members of a bucket that one task compares with as many
BLOCK_ITEMS = 4_000_000  # shingles of these members
SMALL_IDS = 2_000_000  # ids that are broadcast, 8 bytes each

_rng = np.random.Generator(np.random.PCG64(10))
_FACTORS = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, words = word_hashes(pc.ascii_lower(texts.cast(pa.string())))
    grams = window_hashes(words, width)
    sets = []
    for start, end in zip(offsets, offsets[1:]):
        if end - start >= width:
            sets.append(np.unique(grams[start : end - width + 1]))
        elif end > start:
            # Shorter sequences must not meet windows of full width.
            whole = window_hashes(words[start:end], end - start) ^ np.uint64(end - start)
            sets.append(mix64(whole))
        else:
            sets.append(words[:0])
    return sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set that is not empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    joined = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((joined ^ _MASKS[i]) * _FACTORS[i], starts)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), 1))
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS].astype(np.uint64))
    return keys.view(np.int64)


def pack(low: np.ndarray) -> np.ndarray:
    """The low bits of all minima, two to a byte."""
    fields = (low & np.uint32((1 << SIGNATURE_BITS) - 1)).astype(np.uint8)
    return fields[:, 0::2] | (fields[:, 1::2] << SIGNATURE_BITS)


_EQUAL_FIELDS = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures, without the fields equal by chance."""
    equal = _EQUAL_FIELDS[a ^ b].sum(axis=-1, dtype=np.int32) / HASHES
    chance = 2.0**-SIGNATURE_BITS
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    j, chance = percent / 100, 2.0**-SIGNATURE_BITS
    equal = j + (1 - j) * chance
    return j - MARGIN * math.sqrt(equal * (1 - equal) / HASHES) / (1 - chance)


def sketch(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature, bands``; the last three are null for an
    empty set."""

    def build(batches):
        for part in text_groups(batches):
            sets = shingle_sets(part.column("text"), width)
            full = [s for s in sets if len(s)]
            low = minima(full) if full else np.zeros((0, HASHES), np.uint32)
            signatures, bands = iter(pack(low)), iter(band_keys(low).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(signatures).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "signature", "bands"],
            )

    schema = "doc_id bigint, n_shingles bigint, set_key binary, signature binary, bands array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(build, schema)


def _similar(a, b) -> pa.Array:
    return pa.array(estimate(_signatures(a), _signatures(b)) >= least_estimate())


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES // 2)


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``(id, items)``: the whole shingle sets of the documents in ``ids`` (doc_id)."""

    def build(batches):
        for part in text_groups(batches):
            sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), width)]
            numbers = part.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])

    ids = materialize(ids.distinct(), "ids")
    # Few ids travel to the texts; many meet them in a shuffle.
    wanted = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
    chosen = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = materialize(chosen.mapInArrow(build, "id bigint, items array<bigint>"), "sets")
    discard(ids)
    return sets


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of class ids whose full sets are similar enough."""

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(_similar(batch.column("sa"), batch.column("sb")))

    signs = reps.select(F.col("doc_id").alias("id"), "signature")
    met = pairs.join(signs.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
    met = met.join(signs.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    near = materialize(met.select("a", "b", "sa", "sb").mapInArrow(likely, "a bigint, b bigint"), "likely")
    sets = full_sets(docs, near.select(F.col("a").alias("doc_id")).union(near.select("b")), width)
    left = near.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    union = F.size("ia") + F.size("ib") - shared
    linked = materialize(both.where(100 * shared >= percent * union).select("a", "b").distinct(), "linked")
    discard(near)
    discard(sets)
    release(pairs.sparkSession)
    return linked


def _star_pairs(bands: DataFrame) -> DataFrame:
    """Each class of a bucket with the bucket's smallest id."""
    buckets = bands.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("top"))
    buckets = buckets.where("a < top").select("key", "a")
    # A large bucket's rows are split at run time; its row here is one.
    return bands.join(buckets, "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def _likely_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and estimates of the likely pairs of different components in a task.

    A pair that shares several buckets counts in the first one only.
    """
    side, ids, roots = (table.column(c).to_numpy() for c in ("side", "id", "root"))
    signs = _signatures(table.column("signature"))
    bands = np.stack(table.column("bands").combine_chunks().to_numpy(zero_copy_only=False))
    before = bands[:, : int(table.column("band")[0].as_py())]
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
    found = []
    for i in left:
        others = right[(roots[right] != roots[i]) & ((ids[right] > ids[i]) | (side[right] == 2))]
        value = estimate(signs[i], signs[others])
        near = value >= least_estimate()
        others, value = others[near], value[near]
        fresh = ~(before[others] == before[i]).any(axis=1)
        found.append(np.stack([np.full(fresh.sum(), i), others[fresh], value[fresh]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 3))
    return rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2]


def _crossing_links(
    bands: DataFrame, reps: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links between components that share a bucket; no likely pair goes unseen.

    A bucket is cut into blocks of about BLOCK members, and each pair of blocks is a task. A
    first run over signatures finds the members that need their full sets, a second one
    confirms pairs on the sets and hands out a forest of links, so that what leaves a task
    grows with its members and not with its pairs.
    """

    def involved(table):
        a, b, _ = _likely_pairs(table)
        return table.select(["key", "i", "j", "side", "id", "root", "band"]).take(np.unique(np.concatenate([a, b])))

    def link(table):
        a, b, value = _likely_pairs(table)
        ids = table.column("id").to_numpy()
        items = table.column("items").combine_chunks()
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def top(n: int) -> int:
            while root.get(n, n) != n:
                n = root[n]
            return n

        links = []
        for k in np.argsort(-value, kind="stable"):
            x, y = int(a[k]), int(b[k])
            one, two = top(int(ids[x])), top(int(ids[y]))
            if one == two:
                continue
            for n in (x, y):
                if n not in sets:
                    sets[n] = items[n].values.to_numpy()
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                root[max(one, two)] = min(one, two)
                links.append(sorted((int(ids[x]), int(ids[y]))))
        low, high = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    rooted = bands.join(labels.select(F.col("node").alias("id"), "root"), "id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("items")
    )
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("items") / BLOCK_ITEMS)).cast("int")
    mixed = mixed.where("lo < hi").select("key", blocks.alias("blocks"))
    members = rooted.join(mixed, "key")
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Side 0 meets side 2; a block that meets itself is side 1.
    tasks = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.expr("case when own < other then 0 when own = other then 1 else 2 end").alias("side"), "id", "root", "band",
    )
    signs = reps.select(F.col("doc_id").alias("id"), "signature", "bands")
    kinds = "key bigint, i int, j int, side int, id bigint, root bigint, band int"
    some = materialize(tasks.join(signs, "id").groupBy("key", "i", "j").applyInArrow(involved, kinds), "involved")
    sets = full_sets(docs, some.select(F.col("id").alias("doc_id")), width)
    # Of equal ids with several texts one set is enough: they are linked anyway.
    sets_once = sets.groupBy("id").agg(F.max("items").alias("items"))
    ready = some.join(signs, "id").join(sets_once, "id")
    linked = materialize(ready.groupBy("key", "i", "j").applyInArrow(link, "a bigint, b bigint").distinct(), "crossing")
    discard(some)
    discard(sets)
    release(docs.sparkSession)
    return linked


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (doc_id, text)."""
    if percent < PERCENT:
        raise ValueError(f"the bands find pairs from {PERCENT} percent on, not from {percent}")
    spark = docs.sparkSession
    rows = materialize(sketch(docs, width), "sketch")
    usable = rows.where("doc_id is not null and set_key is not null")
    classes = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    # The row whose sketch stands for the class.
    chosen = F.expr("u.set_key = c.set_key and u.doc_id = c.rep")
    reps = usable.alias("u").join(classes.alias("c"), chosen, "left_semi")
    reps = materialize(reps.select("doc_id", "set_key", "signature", "bands", "n_shingles").distinct(), "reps")
    each = F.posexplode("bands").alias("band", "key")
    bands = materialize(reps.select(F.col("doc_id").alias("id"), "n_shingles", each), "bands")
    release(spark)
    # Ids that occur with several sets, or in several classes, are one document.
    same = classes.select(F.col("set_key"), F.col("rep"))
    ids = usable.select("set_key", "doc_id").join(same, "set_key").where("doc_id <> rep")
    repeated = usable.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi"))
    repeated = repeated.where("lo < hi").select("doc_id")
    tied = ids.join(repeated, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    firm = materialize(confirm(_star_pairs(bands), reps, docs, width, percent).union(tied), "firm")
    labels = components(firm)
    release(spark)
    more = _crossing_links(bands, reps, labels, docs, width, percent)
    labels = components(firm.union(more))
    rooted = classes.join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left")
    rooted = rooted.select("set_key", F.coalesce("root", "rep").alias("component"))
    found = rows.join(rooted, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = found.select("doc_id", "n_shingles", component.alias("component_id"))
    discard(bands)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The columns of ``docs``: one row of each component, the one with the smallest id.

    Rows without id stay. Of rows with equal ids the one with the smallest text stays.
    """
    decided = near_duplicates(docs, width, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(decided, "doc_id", "left_semi")
    first = W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*docs.columns))
    one = kept.withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row")
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))
