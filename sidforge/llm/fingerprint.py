"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph is a piece of a text that ends behind line ends or sentence marks, at most
PIECE_CHARS code points long; the pieces of a text put together give the text. Seeded 64-bit
hashes turn a piece into LANES bits, and a text's vector is the sum of its pieces' vectors. The
order of pieces plays no part; adding or subtracting a piece's vector inserts or deletes it.
The fingerprint writes the number of pieces and the lanes modulo 2^16, four hex digits each
(a zero half stands beside the number).

Likeness is the cosine of two vectors after centring (a bit counts +1 or -1), cut to 0..1.
Two empty texts have likeness 1, an empty and another 0.

Everything is DataFrame functions. Pieces are summed in generated code, in the task that holds
the text, so no piece is shuffled. Two 32-bit sums share a number; a text cannot have enough
pieces to fill one.

Documents follow each other by id (null first), then by MD5 of the text. Repeated rows (same
id and text) are one document there and each get its result. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidforge.llm.common import release
from sidforge.operators.identity import with_idx
from sidforge.session import materialize

PIECE_CHARS = 160
SEEDS = 2  # more sums would not fit into compiled code
FIELD = 32
LANES = SEEDS * 64
MODULUS = 1 << 16
_PATTERN = rf"[^\n.!?]{{1,{PIECE_CHARS}}}[\n.!?]*|[\n.!?]+"
_PAIR = (1 << FIELD) + 1  # the lowest bit of both fields


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0))


def sum_pieces(pieces: DataFrame, keys: list[str], piece: str, vector: str) -> DataFrame:
    """One row per ``keys`` with the vector of its pieces: their number, then LANES / 2 sums.

    Null pieces count as none. Bit j of a seed's hash and bit j + FIELD share a sum.
    """
    hashed = pieces.select(
        *keys, piece, *(F.when(F.col(piece).isNotNull(), F.xxhash64(F.lit(s), piece)).alias(f"_h{s}") for s in range(SEEDS))
    )
    sums = [
        F.coalesce(F.sum(F.shiftright(f"_h{s}", j).bitwiseAND(F.lit(_PAIR))), F.lit(0)).alias(f"_s{s}_{j}")
        for s in range(SEEDS)
        for j in range(FIELD)
    ]
    summed = hashed.groupBy(*keys).agg(F.count(piece).alias("_n"), *sums)
    lanes = [f"_s{s}_{j}" for s in range(SEEDS) for j in range(FIELD)]
    return summed.select(*keys, F.array("_n", *lanes).alias(vector))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the union of two multisets; with sign -1 of their difference."""
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def fingerprint(vector: Column) -> Column:
    """All sums modulo 2^16, as hex."""
    low = F.lit(MODULUS - 1)

    def digits(v: Column) -> Column:
        both = F.shiftleft(F.shiftright(v, FIELD).bitwiseAND(low), 16).bitwiseOR(v.bitwiseAND(low))
        return F.lpad(F.lower(F.hex(both)), 8, "0")

    return F.array_join(F.transform(vector, digits), "")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 to 1."""
    mask = F.lit((1 << FIELD) - 1)
    n, m = F.element_at(a, 1), F.element_at(b, 1)

    def low(x: Column, count: Column) -> Column:
        return (2 * x.bitwiseAND(mask) - count).cast("double")

    def high(x: Column, count: Column) -> Column:
        return (2 * F.shiftright(x, FIELD) - count).cast("double")

    def product(x: Column, p: Column, y: Column, q: Column) -> Column:
        return low(x, p) * low(y, q) + high(x, p) * high(y, q)

    def total(values: Column) -> Column:
        return F.aggregate(F.slice(values, 2, LANES // 2), F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: product(x, n, y, m)))
    one = total(F.transform(a, lambda x: product(x, n, x, n)))
    two = total(F.transform(b, lambda y: product(y, m, y, m)))
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.sqrt(F.greatest(one * two, F.lit(1e-300)))))
    empty = (n == 0) | (m == 0)
    return F.when(empty, ((n == 0) & (m == 0)).cast("double")).when(a == b, F.lit(1.0)).otherwise(cosine)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` of each row of ``docs`` (doc_id, text).

    The edited text of a document has its last floor(n_chars / 2) code points replaced by
    as many first ones (or all) of the next document; the first follows the last.

    Only ids are sorted. Texts are shuffled once by their own document; of the next text just
    the part that is needed travels.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    keyed = docs.select(name.alias("key"), "doc_id", text.alias("text"))
    order = keyed.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n"), F.count("*").alias("times")
    )
    order = materialize(with_idx(order, ["doc_id", "key"], "place"), "order")
    count = order.count()
    following = order.select(
        F.col("key").alias("next_key"), ((F.col("place") + count - 1) % max(count, 1)).alias("place")
    )
    pairs = order.join(following, "place").select(
        "key", "doc_id", F.col("n").cast("bigint").alias("n_chars"), "times", F.expr("cast(n div 2 as int)").alias("half"), "next_key"
    )
    pairs = materialize(pairs, "pairs")
    heads = keyed.select(F.col("key").alias("next_key"), "text").join(pairs, "next_key")
    # Repeated rows of the next document give the same head.
    heads = heads.groupBy("key").agg(F.min(F.expr("substring(text, 1, half)")).alias("head"))

    def vectors(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
        each = rows.select(*keys, F.explode_outer(paragraphs(F.col(column))).alias("piece"))
        summed = sum_pieces(each, keys, "piece", "sums").join(pairs.select("key", "times"), "key")
        # Repeated rows are summed together.
        return materialize(summed.select(*keys, F.expr("transform(sums, v -> v div times)").alias("vector")), "vectors")

    kept = F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))")
    # Both joins read one shuffle of the texts.
    met = keyed.select("key", "text").join(heads, "key").select("key", F.concat(kept, "head").alias("edited"))
    met = met.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    edited = vectors(met, ["key", "edited_sha256"], "edited").withColumnRenamed("vector", "edited_vector")
    release(docs.sparkSession)
    own = vectors(keyed, ["key"], "text")
    release(docs.sparkSession)
    after = own.select(F.col("key").alias("next_key"), F.col("vector").alias("next_vector"))
    rows = own.join(edited, "key").join(pairs.drop("half"), "key").join(after, "next_key")
    copies = F.explode(F.expr("sequence(1, cast(times as int))"))
    return rows.withColumn("_copy", copies).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("vector")).alias("fingerprint"),
        fingerprint(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
