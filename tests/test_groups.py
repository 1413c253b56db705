"""Search by groups against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from sidforge.operators import fit, groups, quantize
from sidforge.session import materialize

SCHEMA = "idx bigint, embedding array<double>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 6)) * 8
    book = np.round(centres[rng.integers(0, 12, 300)] + rng.standard_normal((300, 6)), 1)
    book[200:230] = book[:30]  # repeats of lower codes
    rows = np.concatenate([centres[rng.integers(0, 12, 400)] + rng.standard_normal((400, 6)), book[:50], np.repeat(book[:1], 300, axis=0)])
    rows[450:460] = (book[:10] + book[10:20]) / 2  # as far from one codeword as from the other
    return book, rows


def brute(rows, book):
    gaps = np.square(rows[:, None] - book[None]).sum(axis=2)
    return gaps.argmin(axis=1), gaps.min(axis=1)


@pytest.mark.parametrize("count", [1, None, 300])
def test_same_as_brute_force_with_repeats_and_ties(spark, data, count, monkeypatch):
    monkeypatch.setattr(groups, "PART_ROWS", 64)
    book, rows = data
    codebook = fit.codebook_table(spark, [book.tolist()])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], SCHEMA)
    found = groups.nearest_by_groups(df, groups.group_codewords(codebook, groups=count), report=True)
    got = sorted(found.select("idx", "code", "distance", "compared").collect())
    codes, gaps = brute(rows, book)
    assert [r.idx for r in got] == list(range(len(rows)))
    assert np.allclose([r.distance for r in got], gaps, atol=1e-9)
    assert np.mean([r.code == c for r, c in zip(got, codes)]) > 0.99
    assert all(np.isclose(np.square(rows[r.idx] - book[r.code]).sum(), gaps[r.idx], atol=1e-9) for r in got)
    compared = sum(r.compared for r in got)
    if count is None:
        assert compared < 0.5 * len(rows) * len(book)
    if count == 1:
        assert compared == len(rows) * 270


def test_residual_codes_equal_the_broadcast_way(spark, data):
    book, rows = data
    codebook = fit.codebook_table(spark, [book[:40].tolist(), (book[40:90] / 8).tolist()])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows[:200])], SCHEMA)
    by_groups = groups.assign_by_groups(df, groups.groups_of(codebook, 2))
    whole = quantize.assign_codes(df, codebook)
    assert sorted(map(tuple, by_groups.collect())) == sorted(map(tuple, whole.select("idx", "code_0", "code_1").collect()))


def test_open_groups_do_not_copy_vectors_for_each_group(spark, monkeypatch):
    """In many dimensions no bound closes a group; a vector still goes to a block only once."""
    monkeypatch.setattr(groups, "BLOCK_BYTES", 250 * 8 * 24, raising=False)  # 250 words a block
    rng = np.random.default_rng(6)
    book, rows = rng.standard_normal((900, 24)), rng.standard_normal((500, 24))
    book[:300] = 5 + rng.standard_normal((300, 24)) / 100  # more than a block in one group
    rows[:20] = 5
    written = []

    def counted(df, label="table", replaces=None):
        table = materialize(df, label, replaces)
        written.append((table.count(), label))
        return table

    monkeypatch.setattr(groups, "materialize", counted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], SCHEMA)
    grouped = groups.group_codewords(fit.codebook_table(spark, [book.tolist()]))
    found = groups.nearest_by_groups(df, grouped, report=True)
    got = sorted(found.select("idx", "code", "distance", "compared").collect())
    codes, gaps = brute(rows, book)
    assert [(r.idx, r.code) for r in got] == list(enumerate(codes))
    assert np.allclose([r.distance for r in got], gaps, atol=1e-9)
    assert np.mean([r.compared for r in got[20:]]) > 500  # bounds leave most groups open
    assert max(written) <= (900, "grouped")
    # Words are spread over blocks that hold about as many as asked for, also of one group.
    sizes = [r["count"] for r in grouped.words.groupBy("block").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 500
    assert grouped.inside.sum(axis=1).max() > 1


def test_a_batch_with_all_groups_open_is_cut(spark):
    """Rows x groups that a task works on at one time do not grow with the batch."""
    batch = pa.record_batch([pa.array(np.arange(50_000))], ["_row"])
    cut = list(groups._pieces([batch, batch.slice(0, 0)], 1000))
    assert sum(b.num_rows for b in cut) == 50_000
    assert max(b.num_rows for b in cut) * 1000 <= groups.GRID
