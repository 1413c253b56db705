"""Near-duplicate vectors by sorted projection passes.

Every pass hashes the vectors with BITS random hyperplanes and orders them by the bits. A
vector is compared with the SPAN next ones in that order, and pairs with a cosine of at least
THRESHOLD (in double precision) link. Links of all passes make the components. Equal vectors
pass as one, the smallest id, so that copies do not fill a window; they link with it.

The number of passes follows from the number of distinct vectors: two vectors at the threshold
are in one window of a pass when about the first log2(rows / SPAN) bits agree, each with
probability 1 - angle / pi. As many passes are made as find such a pair with probability RECALL
(17 for 50,000 rows, 29 for a million, 62 for a hundred million). Closer pairs are found more
often. This holds for vectors that are spread evenly; an empty table gives no rows.

A window is bounded, a group of near-copies is not. The links of a vector are therefore
counted in its whole component: with the angle of each member to the component's centre,
members whose angle and the largest angle add up to no more than the threshold's angle are
linked with every other member, without comparing them. All other members are compared with
the whole component, block by block.

Vectors that are null, empty, zero or hold a null or non-finite element link with nothing, and
neither do vectors of different length. Rows with equal ids are one vector, the smallest as an
array; all get its result. A row without id has no component, no links, and is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.llm.common import components, release
from sidforge.operators.identity import with_idx
from sidforge.session import discard, materialize

THRESHOLD = 0.95
RECALL = 0.999
BITS = 63
SPAN = 48
BLOCK = 4096  # ranks that one task searches
MEMBERS = 2048  # members of a component compared with as many in one task
_SLACK = 1e-7  # radians; covers the rounding of angles


def passes_for(rows: int, span: int = SPAN, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``."""
    bits = math.log2(max(1.0, rows / span))
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``, in double precision."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(array), width))
    out[np.arange(width) < sizes[:, None]] = array.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    # The largest element first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v, dim)`` of the vectors that can link, once per id."""
    fine = F.expr(
        "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(v, x -> x <> 0)"
    )
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    wide = wide.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    one = wide.groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.withColumn("dim", F.size("v"))


def pass_keys(rows: DataFrame, passes: int, seed: int) -> DataFrame:
    """``(run, dim, key, vec_id)``: the order bits of every vector in every pass."""

    def build(batches):
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    rng = np.random.Generator(np.random.PCG64([seed, int(dim)]))
                    planes[dim] = rng.standard_normal((int(dim), passes * BITS))
                signs = _matrix(part.column("v"), int(dim)) @ planes[dim] > 0
                keys = (signs.reshape(-1, passes, BITS) * weights).sum(axis=2)
                count = part.num_rows
                yield pa.RecordBatch.from_pydict(
                    {
                        "run": pa.array(np.tile(np.arange(passes, dtype=np.int32), count)),
                        "dim": pa.array(np.full(count * passes, dim, np.int32)),
                        "key": pa.array(keys.ravel()),
                        "vec_id": pa.array(np.repeat(part.column("vec_id").to_numpy(), passes)),
                    }
                )

    return rows.mapInArrow(build, "run int, dim int, key bigint, vec_id bigint")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked id with the smallest id its links reach."""
    ids, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(ids))
    return ids[root[other]], ids[other]


def window_links(ranked: DataFrame, span: int, threshold: float) -> DataFrame:
    """Links (a, b) between ranks at most ``span`` apart within a pass, reduced to a forest
    per task."""

    def compare(batch):
        run, dim, vec_id = (batch.column(c).to_numpy() for c in ("run", "dim", "vec_id"))
        order = np.argsort(batch.column("rank").to_numpy(), kind="stable")
        rows = unit(_matrix(batch.column("v"), int(dim.max())))[order]
        run, dim, vec_id = run[order], dim[order], vec_id[order]
        pairs = []
        for d in range(1, min(span, len(rows) - 1) + 1):
            close = np.einsum("ij,ij->i", rows[:-d], rows[d:]) >= threshold
            close &= (run[:-d] == run[d:]) & (dim[:-d] == dim[d:])
            at = np.flatnonzero(close)
            pairs.append((vec_id[at], vec_id[at + d]))
        a = np.concatenate([p[0] for p in pairs] or [vec_id[:0]])
        b = np.concatenate([p[1] for p in pairs] or [vec_id[:0]])
        low, high = forest(a, b)
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    # The first ranks of a block belong to the one before as well.
    block = F.expr(f"rank div {BLOCK}")
    both = F.when((F.col("rank") % BLOCK < span) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    return ranked.withColumn("block", F.explode(both)).groupBy("block").applyInArrow(compare, "a bigint, b bigint")


def count_links(rows: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``(vec_id, n_links)`` of the members of components, exact within each."""
    members = rows.join(labels.select(F.col("node").alias("vec_id"), "root"), "vec_id")

    def units(batches):
        for batch in batches:
            if batch.num_rows:
                dims = batch.column("dim").to_numpy()
                wide = unit(_matrix(batch.column("v"), int(dims.max())))
                lists = [r[:d].tolist() for r, d in zip(wide, dims)]
                columns = [batch.column(c) for c in ("vec_id", "root")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.list_(pa.float64()))], names=["vec_id", "root", "v"])

    members = members.select("vec_id", "root", "v", "dim").mapInArrow(units, "vec_id bigint, root bigint, v array<double>")
    members = materialize(members, "members")
    cells = members.select("root", F.posexplode("v").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("x"))
    centres = cells.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    centres = centres.select("root", F.transform("c", lambda s: s["x"]).alias("c"))

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    cosine = dot("v", "c") / F.sqrt(F.greatest(dot("c", "c"), F.lit(1e-300)))
    angled = members.join(centres, "root").select(
        "vec_id", "root", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("angle")
    )
    angled = materialize(angled, "angles")
    widest = angled.groupBy("root").agg(F.max("angle").alias("widest"), F.count("*").alias("n"))
    placed = angled.join(widest, "root")
    sure = F.col("angle") + F.col("widest") <= math.acos(threshold) - _SLACK
    counted = placed.where(sure).select("vec_id", (F.col("n") - 1).alias("n_links"))
    open_rows = materialize(placed.where(~sure).select("vec_id", "root", "n"), "open")

    def compare(batch):
        side = batch.column("side").to_numpy()
        ids = batch.column("vec_id").to_numpy()
        sizes = np.diff(batch.column("v").combine_chunks().offsets.to_numpy())
        rows = _matrix(batch.column("v"), int(sizes.max()))
        ours, theirs = side == 0, side == 1
        near = rows[ours] @ rows[theirs].T >= threshold
        near &= (ids[ours][:, None] != ids[theirs][None, :]) & (sizes[ours][:, None] == sizes[theirs][None, :])
        return pa.table({"vec_id": ids[ours], "n_links": near.sum(axis=1).astype(np.int64)})

    # Open members of a component in blocks, against all its members in blocks.
    groups = open_rows.groupBy("root").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    groups = groups.select(
        "root", F.ceil(F.col("k") / MEMBERS).cast("int").alias("mine"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("all")
    )
    ours = members.join(open_rows.select("vec_id"), "vec_id").join(groups, "root")
    ours = ours.select(
        "root", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("mine")).cast("int").alias("i"),
        F.explode(F.expr("sequence(0, all - 1)")).alias("j"), F.lit(0).alias("side"),
    )
    theirs = members.join(groups, "root").select(
        "root", "vec_id", "v", F.explode(F.expr("sequence(0, mine - 1)")).alias("i"),
        F.pmod(F.xxhash64("vec_id"), F.col("all")).cast("int").alias("j"), F.lit(1).alias("side"),
    )
    tasks = ours.unionByName(theirs).groupBy("root", "i", "j")
    compared = tasks.applyInArrow(compare, "vec_id bigint, n_links bigint")
    return counted.union(compared.groupBy("vec_id").agg(F.sum("n_links").alias("n_links")))


def link_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, span: int = SPAN, seed: int = 9
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors`` (vec_id, embedding)."""
    rows = materialize(usable(vectors), "vectors")
    once = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    once = materialize(once.withColumn("dim", F.size("v")), "once")
    shared = once.where("copies > 1").select("v", F.col("vec_id").alias("a"))
    same = rows.join(shared, "v").where("vec_id <> a").select("a", F.col("vec_id").alias("b"))
    once = once.drop("copies")
    passes = passes or passes_for(once.count(), span, threshold)
    ranked = with_idx(pass_keys(once, passes, seed), ["run", "dim", "key", "vec_id"], "rank")
    ranked = ranked.select("run", "rank", "vec_id").join(once, "vec_id")
    links = materialize(window_links(ranked, span, threshold).union(same), "links")
    release(vectors.sparkSession)
    labels = components(links)
    counts = count_links(rows, labels, threshold)
    found = labels.select(F.col("node").alias("vec_id"), "root").join(counts, "vec_id", "left")
    found = materialize(found, "found")
    discard(links)
    out = vectors.select("vec_id").join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
