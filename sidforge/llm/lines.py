"""Line dedup over levelled, sorted runs of line hashes.

A text is split at line feeds; null and empty texts are one empty line. A line's key is the
line without ASCII white space at both ends and with ASCII capitals lowered. Keys of at least
LEAST_CHARS code points that occur in at least LEAST_DOCS documents lose their lines in all
documents but the one with the largest id; all other lines stay.

Keys are hashed to 128 bits. Documents arrive in batches. A run is a table sorted by hash, with
the number of documents and the largest id of each. A batch is anti-joined with the runs: hashes
that one of them has settled (enough documents, an id at least as large) are not stored again,
so a line that is everywhere is stored a few times only. The rest becomes the batch's own run.
Two runs of a level are merged into one of the next level, so there is one run per level at most.
All runs are bucketed alike, hence joins between them move no rows.

Rows with equal ids are one document. A row without an id counts for no line and keeps all of
its lines. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.llm.common import WHITE, release, schema_of, text_groups
from sidforge.session import discard, materialize, scratch_path

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 4
BUCKET_KEYS = 4_000_000  # hashes of one bucket, on average
_WHITE = WHITE.encode()


def line_hash(line: bytes) -> bytes | None:
    """128 bits for the key of a line, None if the key is too short to count."""
    key = line.strip(_WHITE).lower()  # of bytes: ASCII letters only
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode(errors="replace")) < LEAST_CHARS:
        return None
    return hashlib.sha256(key).digest()[:16]


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def line_hashes(docs: DataFrame) -> DataFrame:
    """``(doc_id, hash)``, once per text, for every key that counts."""

    def run(batches):
        for batch in text_groups(batches):
            rows, found = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                own = {h for h in map(line_hash, _lines(text)) if h}
                rows += [i] * len(own)
                found += own
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.record_batch([ids, pa.array(found, pa.binary())], ["doc_id", "hash"])

    texts = docs.select("doc_id", "text").where("doc_id is not null")
    return texts.mapInArrow(run, schema_of(docs.select("doc_id")) + ", hash binary")


class Runs:
    """Levelled runs of ``(hash, docs, last)``, each sorted and bucketed by hash."""

    def __init__(self, spark: SparkSession, buckets: int, least_docs: int = LEAST_DOCS):
        self.spark, self.buckets, self.least_docs = spark, buckets, least_docs
        self.levels: list[DataFrame | None] = []
        self._named: dict[int, tuple[str, DataFrame]] = {}

    def add(self, batch: DataFrame) -> None:
        """Take in ``batch`` (doc_id, hash), of documents that no earlier batch had."""
        fresh = batch.groupBy("hash").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
        for run in filter(None, self.levels):
            settled = run.where(F.col("docs") >= self.least_docs).select("hash", F.col("last").alias("_last"))
            met = (F.col("b.hash") == F.col("s.hash")) & (F.col("b.last") <= F.col("s._last"))
            fresh = fresh.alias("b").join(settled.alias("s"), met, "left_anti")
        run, level = self._write(fresh), 0
        while level < len(self.levels) and self.levels[level] is not None:
            run = self._merge(self.levels[level], run)
            self.levels[level] = None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def compact(self) -> DataFrame | None:
        """All levels as one run."""
        run = None
        for other in filter(None, self.levels):
            run = other if run is None else self._merge(other, run)
        self.levels = [run]
        return run

    def close(self) -> None:
        for run in filter(None, self.levels):
            self._drop(run)
        self.levels = []

    def _merge(self, one: DataFrame, other: DataFrame) -> DataFrame:
        both = one.alias("a").join(other.alias("b"), "hash", "full_outer").select(
            "hash",
            (F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))).alias("docs"),
            F.greatest("a.last", "b.last").alias("last"),  # skips nulls
        )
        merged = self._write(both)
        self._drop(one)
        self._drop(other)
        return merged

    def _write(self, rows: DataFrame) -> DataFrame:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        writer = rows.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
        writer.option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        run._scratch_path = path
        self._named[id(run)] = (name, run)
        return run

    def _drop(self, run: DataFrame) -> None:
        name, _ = self._named.pop(id(run))
        self.spark.sql(f"drop table {name}")
        discard(run)


def drop_repeated_lines(
    docs: DataFrame, keep: list[str], batches: int = BATCHES, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """The columns in ``keep`` with ``n_lines``, ``n_dropped`` and ``kept_text``, a row per row."""
    spark = docs.sparkSession
    hashed = line_hashes(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    hashed = materialize(hashed, "line-hashes")
    runs = Runs(spark, max(8, hashed.count() // BUCKET_KEYS), least_docs)
    for number in range(batches):
        runs.add(hashed.where(F.col("batch") == number).drop("batch"))
    settled = runs.compact().where(F.col("docs") >= least_docs).select("hash", "last")
    # Lines meet their hash without their text; a document's list is no longer than its lines.
    gone = hashed.join(settled, "hash").where("doc_id < last").groupBy("doc_id")
    gone = materialize(gone.agg(F.collect_set("hash").alias("_gone")), "lines-gone")
    runs.close()
    discard(hashed)
    release(spark)

    rows = docs.select("doc_id", "text", F.struct(*keep).alias("_row"))
    met = rows.join(gone, "doc_id", "left").select("_row", "text", "_gone")

    def run(batches):
        for batch in text_groups(batches):
            lines, dropped, kept = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, hashes in zip(texts, batch.column("_gone").to_pylist()):
                own = stay = _lines(text)
                if hashes:
                    hashes = set(hashes)
                    stay = [x for x in own if line_hash(x) not in hashes]
                lines.append(len(own))
                dropped.append(len(own) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.record_batch(
                [batch.column("_row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["_row", "n_lines", "n_dropped", "kept_text"],
            )

    out = met.mapInArrow(run, schema_of(met.select("_row")) + ", n_lines bigint, n_dropped bigint, kept_text string")
    return out.select("_row.*", "n_lines", "n_dropped", "kept_text")
