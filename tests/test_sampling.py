"""Samples, shuffles, kept models, streaming, and the shared folder."""

import heapq
import math
import random
from hashlib import md5
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sidforge import session
from sidforge.operators import fit, quantize, sampling, selection
from sidforge.sources import model as models
from sidforge.streaming.assign import stream_assign


def ordered(n, *salt):
    return sorted(range(n), key=lambda i: md5("-".join(map(str, (i, *salt))).encode()).hexdigest())


@pytest.mark.parametrize("leaf", [1, 200_000])
@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_row_sample(spark, n, leaf, monkeypatch):
    monkeypatch.setattr(sampling, "LEAF_KEYS", leaf)
    rows = [r.idx for r in sampling.row_sample(spark.range(1000).toDF("idx"), n, 5).collect()]
    assert rows == sorted(ordered(1000, 5)[:n])


def test_cutoff_with_equal_keys(spark):
    df = spark.range(100).toDF("idx")
    same = sampling.smallest_keys(df, F.lit("f" * 16), 30)
    assert sorted(r.idx for r in same.collect()) == list(range(30))


@pytest.mark.parametrize(
    "rows, n", [(1000, 250), (1000, 300), (1050, 2000), (1050, 1000), (40, 10), (40, 500), (100, 100), (1000, 1)]
)
def test_block_sample(spark, rows, n):
    got = [r.idx for r in sampling.block_sample(spark.range(rows).toDF("idx"), n).collect()]
    total = max(rows // 100, 1)
    wanted = min(n, rows)
    picks = sorted(ordered(total, 2024)[: min(math.ceil(wanted / 100), total)])
    blocks = [i for b in picks for i in range(b * 100, min((b + 1) * 100, rows))]
    assert got == blocks[:wanted]


def test_block_sample_opens_only_the_files_it_needs(spark, folder, monkeypatch):
    # Fixed borders. The last block picked is cut at row 77,549, and a file starts behind it.
    borders = [*range(0, 77_501, 2_500), 77_550, *range(80_000, 100_001, 2_500)]
    for n, (a, b) in enumerate(zip(borders, borders[1:])):
        part = spark.range(a, b, 1, 1).selectExpr("id as value")
        part.write.mode("append").parquet(f"{folder}/parts/{n:03d}")
        Path(f"{folder}/rows").mkdir(exist_ok=True)
        next(Path(f"{folder}/parts/{n:03d}").glob("part-*")).rename(f"{folder}/rows/part-{n:05d}.parquet")
    read = lambda: spark.read.parquet(f"{folder}/rows")
    assert sampling.block_sample_files(read(), 10**6).count() == 100_000
    monkeypatch.setattr(sampling, "PRUNED_BLOCKS", 1)
    unpruned = [r.idx for r in sampling.block_sample_files(read(), 450).collect()]
    monkeypatch.undo()
    sample = sampling.block_sample_files(read(), 450)
    whole = [r.idx for r in sampling.block_sample(spark.range(100_000).toDF("idx"), 450).collect()]
    # All other files are spoilt before the rows are read.
    files = sorted(Path(f"{folder}/rows").glob("part-*"))
    sizes = [spark.read.parquet(str(f)).count() for f in files]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    needed = {next(f for f, end in zip(files, ends) if i < end) for i in whole}
    assert len(needed) < 10
    for f in set(files) - needed:
        f.write_bytes(b"x" * f.stat().st_size)
    rows = sample.collect()
    assert [r.idx for r in rows] == whole == unpruned
    assert all(r.idx == r.value for r in rows)


def test_shuffles_are_permutations(spark):
    df = spark.range(3000).toDF("idx")
    orders = []
    for epoch in (0, 1):
        rows = sorted(sampling.shuffle_batches(df, epoch, 7, 256).collect(), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(3000))
        assert all(r.batch == r.position // 256 for r in rows)
        assert [r.idx for r in rows] == ordered(3000, epoch, 7)
        orders.append([r.idx for r in rows])
    assert orders[0] != orders[1]


def kept_by_replay(rates, limit):
    """Files on disk after every epoch: a queue of the newest and a heap of the best."""
    newest, best, files = [], [], set()
    for epoch, rate in enumerate(rates):
        entry = (-rate, f"epoch_{epoch}_collision_{rate:.4f}_model.pth")
        files.add(entry)
        if len(newest) < limit:
            newest.append(entry)
            heapq.heappush(best, entry)
            continue
        old = newest.pop(0)
        newest.append(entry)
        if rate < -best[0][0]:
            bad = heapq.heapreplace(best, entry)
            if bad not in newest:
                files.discard(bad)
        if old not in best:
            files.discard(old)
    return sorted(int(name.split("_")[1]) for _, name in files)


def test_kept_models_equal_the_queue_and_heap(spark):
    rng = random.Random(3)
    runs, wanted = [], {}
    for limit in (1, 2, 5):
        runs.clear()
        wanted.clear()
        for run in range(40):
            rates = [rng.choice([0.1, 0.2, 0.3, 0.4]) for _ in range(rng.randint(1, 30))]
            losses = [rng.choice([1.0, 2.0, 3.0]) for _ in rates]
            runs += [(str(run), e, loss, r) for e, (loss, r) in enumerate(zip(losses, rates))]
            wanted[str(run)] = (
                kept_by_replay(rates, limit), losses.index(min(losses)), rates.index(min(rates))
            )
        df = spark.createDataFrame(runs, "run string, epoch int, loss double, collision_rate double")
        rows = selection.select_models(df, limit).collect()
        assert len(rows) == len(runs)
        for run, (kept, loss, rate) in wanted.items():
            mine = [r for r in rows if r.run == run]
            assert sorted(r.epoch for r in mine if r.kept) == kept
            assert [r.epoch for r in mine if r.best_loss] == [loss]
            assert [r.epoch for r in mine if r.best_collision] == [rate]


def stream_case(spark, folder):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "idx bigint, embedding array<float>")
    df.repartition(5).write.parquet(f"{folder}/in")
    model = models.Quantizer(fit.codebook_table(spark, [[[0.0, 0.0], [5.0, 1.0]], [[0.0, 0.0], [1.0, 1.0]]]))
    return df, model


def run_stream(spark, folder, model):
    return stream_assign(
        spark, f"{folder}/in", f"{folder}/out", model, 2, f"{folder}/state", files_per_trigger=2
    )


def test_stream_equals_batch_and_resumes(spark, folder):
    df, model = stream_case(spark, folder)
    assert sorted(run_stream(spark, folder, model).collect()) == sorted(model.assign(df).collect())
    # Nothing is assigned twice; new files are picked up where the last run stopped.
    assert run_stream(spark, folder, model).count() == 60
    extra = spark.createDataFrame([(60, [float("nan"), float("inf")])], "idx bigint, embedding array<float>")
    extra.write.mode("append").parquet(f"{folder}/in")
    again = run_stream(spark, folder, model)
    assert again.count() == 61
    assert tuple(again.where("idx = 60").first()) == (60, 0, 0)


def test_stream_refuses_another_width(spark, folder):
    _, model = stream_case(spark, folder)
    bad = spark.createDataFrame([(61, [1.0, 2.0, 3.0])], "idx bigint, embedding array<float>")
    bad.write.mode("append").parquet(f"{folder}/in")
    with pytest.raises(Exception, match="expected 2 elements, found 3"):
        run_stream(spark, folder, model)


def test_written_tables_can_be_discarded(spark):
    table = session.materialize(spark.range(5))
    path = Path(table._scratch_path)
    assert path.exists() and table.count() == 5
    newer = session.materialize(table, replaces=table)
    assert not path.exists() and newer.count() == 5
    assert str(path).startswith(session.shared_folder(spark))


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/dir/"}
    assert session.shared_folder(Session()) == "hdfs://shared/dir"


def test_no_step_depends_on_executor_memory():
    for path in Path(session.__file__).parent.rglob("*.py"):
        assert "localCheckpoint" not in path.read_text()


def test_assignment_plan_reads_only_what_it_needs(spark, folder):
    df = spark.createDataFrame([(1, [1.0], "x")], "idx bigint, embedding array<float>, note string")
    df.write.parquet(f"{folder}/wide")
    book = fit.codebook_table(spark, [[[0.0], [1.0]]])
    coded = quantize.assign_codes(spark.read.parquet(f"{folder}/wide"), book, keep=["idx"])
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<idx:bigint,embedding:array<float>>" in plan


def test_block_sample_refuses_numbers_with_gaps(spark):
    rows = spark.range(200).toDF("idx")
    assert sampling.block_sample(rows, 30, 10).count() == 30
    for wrong in (rows.where("idx <> 7"), rows.withColumn("idx", F.col("idx") + 1), rows.union(rows.where("idx = 3"))):
        with pytest.raises(ValueError, match="does not run"):
            sampling.block_sample(wrong, 30, 10)
