"""Vector files: splits, round trips, distributed writes, and what is refused."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.sources import vecfiles

KINDS = ["fvecs", "bvecs", "ivecs", "fbin"]


def rows_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def one_file(path, kind):
    (name,) = os.listdir(path)
    return f"{path}/{name}"


@pytest.mark.parametrize("kind", KINDS)
def test_splits_equal_one_split(spark, tmp_path, kind):
    x, at = np.arange(40).reshape(10, 4), str(tmp_path / kind)
    vecfiles.write(rows_of(spark, x), at, kind)
    whole, size = vecfiles.read(spark, at), 4 * (4 if kind != "bvecs" else 1) + (0 if kind == "fbin" else 4)
    cut = vecfiles.read(spark, at, split_bytes=4 * size)
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() == 3
    want = [(i, r.tolist()) for i, r in enumerate(x)]
    for df in (whole, cut):
        assert sorted((r.vec_id, r.embedding) for r in df.collect()) == want
    assert os.path.getsize(one_file(at, kind)) == 10 * size + (8 if kind == "fbin" else 0)
    raw = open(one_file(at, kind), "rb").read()  # the bytes themselves
    assert np.frombuffer(raw[:4], "<i4")[0] == (10 if kind == "fbin" else 4)
    first = vecfiles.read(spark, at, kind, max_rows=5, split_bytes=2 * size)
    assert first.rdd.getNumPartitions() == 3 and sorted(r.vec_id for r in first.collect()) == [0, 1, 2, 3, 4]


def test_tasks_write_their_own_files(spark, tmp_path):
    x, at = np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32), str(tmp_path / "many")
    vecfiles.write(rows_of(spark, x).repartition(7), at, "fbin", parts=4)
    names = sorted(os.listdir(at))
    assert names == [f"part-{n:05d}.fbin" for n in range(4)]  # and nothing temporary
    got = vecfiles.read(spark, at, ids="all").orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(50)) and np.array_equal(np.array([r.embedding for r in got], np.float32), x)
    assert sorted(r.vec_id for r in vecfiles.read(spark, at, files=1).collect()) == list(range(vecfiles.read(spark, at, files=1).count()))
    more = rows_of(spark, x[:5]).select("embedding").coalesce(1)
    more.write.format("vectors").option("kind", "fbin").mode("append").save(at)
    assert sorted(os.listdir(at))[-1] == "part-00004.fbin" and vecfiles.read(spark, at).count() == 55
    vecfiles.write(rows_of(spark, x[:2]), at, "fbin")
    assert os.listdir(at) == ["part-00000.fbin"] and vecfiles.read(spark, at).count() == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "bad")
    rows = rows_of(spark, np.ones((6, 2))).withColumn("embedding", F.when(F.col("vec_id") == 5, F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="one dimension"):
        vecfiles.write(rows, at, "fvecs", parts=2)
    assert not os.path.exists(at) or os.listdir(at) == []


def test_empty_tables_and_values_out_of_range(spark, tmp_path):
    vecfiles.write(rows_of(spark, np.zeros((0, 3))), str(tmp_path / "none"), "fvecs")
    assert vecfiles.read(spark, str(tmp_path / "none"), "fvecs").collect() == []
    vecfiles.write(rows_of(spark, np.array([[-3.0, 2.9, 300.0]])), str(tmp_path / "b"), "bvecs")
    assert vecfiles.read(spark, str(tmp_path / "b")).first().embedding == [0, 2, 255]
    vecfiles.write(rows_of(spark, np.array([[2.0**31 - 128, 1.0]])), str(tmp_path / "i"), "ivecs")
    assert vecfiles.read(spark, str(tmp_path / "i")).first().embedding == [2**31 - 128, 1]


@pytest.mark.parametrize("kind", KINDS)
def test_bad_files_are_refused(spark, tmp_path, kind):
    at = str(tmp_path / kind)
    vecfiles.write(rows_of(spark, np.ones((3, 3))), at, kind)
    raw = open(one_file(at, kind), "rb").read()
    for bad in (raw[:-1], raw + b"1"):
        path = tmp_path / f"bad.{kind}"
        path.write_bytes(bad)
        with pytest.raises(Exception, match="record|header"):
            vecfiles.read(spark, str(path)).collect()
    if kind != "fbin":
        mixed = tmp_path / f"mixed.{kind}"
        mixed.write_bytes(raw[: len(raw) // 3] + np.array([7], "<i4").tobytes() + raw[len(raw) // 3 + 4 :])
        with pytest.raises(Exception, match="several dimensions"):
            vecfiles.read(spark, str(mixed)).collect()
    with pytest.raises(Exception, match="not a vector file"):
        (tmp_path / "x.txt").write_text("no")
        vecfiles.read(spark, str(tmp_path / "x.txt")).collect()


def test_raw_arrays(spark, tmp_path):
    cells = spark.createDataFrame([(q, p, (1 << 40) + 10 * q + p) for q in range(7) for p in range(3)], "query_id long, pos int, value long")
    vecfiles.write_raw(cells.repartition(5), str(tmp_path / "gt"), "uint64", parts=2)
    got = vecfiles.read_raw(spark, str(tmp_path / "gt"), "uint64", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cells.collect()))
    with pytest.raises(Exception, match="whole number"):
        vecfiles.read_raw(spark, str(tmp_path / "gt"), "uint64", 4).collect()
