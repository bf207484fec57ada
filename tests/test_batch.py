import pytest
from pyspark.sql import functions as F
from tessera.operators.batch import Batch


@pytest.fixture
def batch(spark):
    return Batch.of(spark.createDataFrame([(i * 10, f"v{i}") for i in range(7)], "k long, v string"), "k", meta={"a": 1})


def keys(b):
    return [r.k for r in b.df.orderBy("row").collect()]


BASE = [i * 10 for i in range(7)]


@pytest.mark.parametrize("cut", [(None, None, None), (1, 5, 2), (-3, None, None), (None, None, -1), (5, 1, -2), (3, 3, None), (None, -2, 3)])
def test_slice(batch, cut):
    out = batch.slice(*cut)
    assert keys(out) == BASE[slice(*cut)] and len(out) == len(BASE[slice(*cut)])
    assert [r.row for r in out.df.orderBy("row").collect()] == list(range(len(out)))


def test_selection(batch):
    assert keys(batch.take([3, 3, -1, 0])) == [30, 30, 60, 0]
    with pytest.raises(IndexError):
        batch.take([7])
    assert keys(batch.where_mask(F.col("k") % 20 == 0)) == [0, 20, 40, 60]
    a, b = batch.pop(["v"])
    assert a.columns == ["v"] and b.columns == ["k"]
    with pytest.raises(KeyError):
        batch.pop(["nope"])
    assert batch.rename(["k"], ["q"]).columns == ["q", "v"]
    with pytest.raises(ValueError):
        batch.rename(["k"], ["q", "r"])


def test_replication(batch):
    assert keys(batch.repeat(2)) == [x for x in BASE for _ in range(2)]
    assert keys(batch.repeat(2, interleave=False)) == BASE * 2
    assert keys(batch.repeat_each((F.col("k") / 10 % 3).cast("int"))) == [10, 20, 20, 40, 50, 50]
    assert keys(batch.fold(3).unfold(3)) == BASE


def test_padding(batch):
    padded, n = batch.pad_to_divisor(4)
    assert n == 1 and keys(padded) == [*BASE, 0] and keys(padded.unpad(n)) == BASE
    wide, n = batch.pad_to_divisor(20)
    assert n == 13 and keys(wide) == [BASE[i % 7] for i in range(20)]
    assert keys(batch.padding(2, "first")) == [*BASE, 0, 0] and keys(batch.padding(2, "x")) == [*BASE, 60, 60]
    assert [keys(c) for c in batch.chunks(4, auto_pad=True)] == [[0, 10], [20, 30], [40, 50], [60, 0]]
    with pytest.raises(ValueError):
        batch.chunks(4)


def test_combination(batch):
    other = Batch(batch.df.select("row", "k", F.upper("v").alias("w")), {"b": 2})
    u = batch.union(other)
    assert set(u.columns) == {"k", "v", "w"} and u.meta == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        batch.union(Batch(batch.df.select("row", (F.col("k") + 1).alias("k"))))
    with pytest.raises(ValueError):
        batch.union(batch.slice(0, 3))
    assert keys(Batch.concat([batch, batch.slice(0, 2)])) == [*BASE, 0, 10]
    with pytest.raises(ValueError):
        Batch.concat([batch, other])
    mini = batch.slice(0, 6).mini_batches(3, 2, seed=1).collect()
    assert sorted((r.epoch, r.batch) for r in mini) == [(e, b) for e in (0, 1) for b in (0, 1) for _ in range(3)]
