"""Code assignment for vectors that keep arriving as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sidforge.functions.vectors import checked
from sidforge.operators.growing import add_batch, read_index
from sidforge.sources.model import Quantizer
from sidforge.sources.vectors import METRICS, observe_vectors


def stream_assign(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    model: Quantizer,
    dim: int,
    checkpoint: str,
    schema: str = "idx bigint, embedding array<float>",
    vec: str = "embedding",
    files_per_trigger: int = 64,
    metrics: list[dict] | None = None,
) -> DataFrame:
    """Assign codes to every file in ``in_dir`` not seen before, then stop.

    Stateless, so late or repeated triggers need no watermark. ``checkpoint``
    belongs on the shared folder; a restart goes on after the last written batch.

    A model beyond the broadcast limit needs written tables between its passes, which a
    streaming plan cannot hold; its batches are assigned and written one by one. A batch that
    is run again replaces its own folder.

    ``metrics`` receives what each batch held, as :func:`observe_vectors` counts it on the way.
    """
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(in_dir)
    )
    if metrics is not None:
        arriving = observe_vectors(arriving, METRICS, vec)
    arriving = arriving.withColumn(vec, checked(vec, dim))
    if model.is_small():
        sink = model.assign(arriving, vec).writeStream.format("parquet").option("path", out_dir)
    else:

        def write_batch(rows: DataFrame, number: int) -> None:
            model.assign(rows, vec).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

        sink = arriving.writeStream.foreachBatch(write_batch)
    sink = sink.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = sink.start()
    query.awaitTermination()
    if metrics is not None:
        for progress in query.recentProgress:
            seen = progress.observedMetrics.get(METRICS)
            if seen is not None and seen["rows"]:
                metrics.append({"batch": progress.batchId, **seen.asDict()})
    return spark.read.parquet(out_dir).drop("batch")


def stream_index(
    spark: SparkSession,
    in_dir: str,
    root: str,
    model: Quantizer,
    dim: int,
    checkpoint: str,
    schema: str = "idx bigint, embedding array<float>",
    vec: str = "embedding",
    idx: str = "idx",
    files_per_trigger: int = 64,
) -> DataFrame:
    """Index every file in ``in_dir`` not seen before: codes, and the rank behind the items
    that came earlier. A micro-batch that is run again writes the same rows into its own folder."""
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(in_dir)
    ).withColumn(vec, checked(vec, dim))

    def write_batch(rows: DataFrame, number: int) -> None:
        add_batch(model.assign(rows, vec, [idx]), root, number, idx)

    sink = arriving.writeStream.foreachBatch(write_batch)
    sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_index(spark, root)
