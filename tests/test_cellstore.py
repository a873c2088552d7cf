"""The cell store: ids after a step, files that stay, versions, measured bytes."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.sources.cellstore import CellStore

ROWS = "vec_id long, e array<double>, mini_id long, mega_id long"


def table(spark, groups):
    """Rows of megas: {mega: [size of each mini]}; vec_ids count up from a first one in each."""
    out, mini = [], 0
    for mega, (first, sizes) in groups.items():
        for n in sizes:
            out += [(first + i, [float(first), float(i)], mini, mega) for i in range(n)]
            first, mini = first + n, mini + 1
    return spark.createDataFrame(out, ROWS)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/cells") for f in names if f.endswith(".parquet")}


def state(store):
    return {r.vec_id: (r.mega_id, r.mini_id) for r in store.rows().collect()}


@pytest.fixture()
def store(spark, tmp_path):
    made = CellStore(spark, str(tmp_path / "index"))
    assert made.version == -1 and made.rows().collect() == []
    made.append(table(spark, {7: (0, [2, 3]), 9: (10, [4]), 11: (20, [1, 1, 1]), 12: (30, [5])}))
    return made


def test_first_ids_are_dense(store):
    got = state(store)
    assert got[0] == (0, 0) and got[2] == (0, 1) and got[10] == (1, 2) and got[22] == (2, 5) and got[30] == (3, 6)
    assert store.version == 0 and len(got) == 17


def test_a_step_keeps_other_files_and_hands_ids_out_again(spark, store):
    before = files(store.path)
    step = store.replace(spark.createDataFrame([(1,), (2,)], "mega_id long"), table(spark, {0: (10, [2, 2]), 1: (20, [3]), 2: (50, [6, 1])}))
    got, after = state(store), files(store.path)
    assert all(after[f] == t for f, t in before.items())
    assert {got[10][0], got[20][0], got[50][0]} == {1, 2, 4}  # two ids again, one after the last
    assert got[0] == (0, 0) and got[30] == (3, 6)  # untouched
    assert sorted({m for _, m in got.values()}) == list(range(8)) and sorted({m for m, _ in got.values()}) == list(range(5))
    assert (step.rows, step.bytes) == (14, 14 * 2 * 4) and step.megas.count() == 0
    new = [f for f in after if f not in before]
    assert new and all("/v=1/" in f for f in new)
    read = store.rows(spark.createDataFrame([(1,)], "mega_id long"))
    assert {r.vec_id for r in read.collect()} == {10, 11, 12, 13}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+L", plan)


def test_holes_are_filled_by_the_last(spark, store):
    before = files(store.path)
    step = store.replace(spark.createDataFrame([(0,), (1,)], "mega_id long"), table(spark, {5: (0, [9])}))
    got = state(store)
    assert sorted({m for m, _ in got.values()}) == [0, 1, 2] and sorted({m for _, m in got.values()}) == list(range(5))
    assert [tuple(r) for r in step.megas.collect()] == [(3, 1)]
    assert {got[i][0] for i in range(9)} == {0} and got[30][0] == 1 and {got[i][0] for i in (20, 21, 22)} == {2}
    assert sorted(map(tuple, step.minis.collect())) == [(5, 1), (6, 2)] and got[22][1] == 1 and got[30][1] == 2
    assert all(files(store.path)[f] == t for f, t in before.items())  # a move rewrites nothing
    history = {r.version: r for r in store.history().collect()}
    assert history[1].megas_moved == 1 and history[1].megas_out == 2 and history[0].rows == 17 and history[1].rows == 9


def test_versions_and_vacuum(spark, store):
    first = state(store)
    store.replace(spark.createDataFrame([(3,)], "mega_id long"), table(spark, {0: (30, [5])}))
    assert {r.vec_id: (r.mega_id, r.mini_id) for r in store.rows(version=0).collect()} == first
    assert store.vacuum() == 1 and len(state(store)) == 17 and store.vacuum() == 0


def test_a_step_without_its_end_does_not_count(spark, store):
    first = state(store)
    table(spark, {0: (90, [3])}).select("vec_id", "e", F.lit(0).alias("mini_no"), F.lit(77).alias("cell")).write.partitionBy("cell").parquet(f"{store.path}/cells/v=1")
    assert state(store) == first
    store.append(table(spark, {0: (40, [2])}))
    assert len(state(store)) == 19 and not any("cell=77" in f for f in files(store.path))


def test_everything_may_go(spark, store):
    store.replace(store.megas().select("mega_id"), table(spark, {}))
    assert state(store) == {}
    store.append(table(spark, {3: (0, [1])}))
    assert state(store) == {0: (0, 0)}


def test_rounds_redo_every_mega_once(spark, tmp_path):
    from quiverlake.operators import maintain

    rng = np.random.default_rng(2)
    out = [(i, (rng.normal(size=3) * (1 + i % 12)).tolist(), i % 24, i % 12) for i in range(720)]
    store = CellStore(spark, str(tmp_path / "rounds"))
    store.append(spark.createDataFrame(out, ROWS))
    before = {r.vec_id: tuple(r.e) for r in store.rows().collect()}
    rounds = maintain.recluster_in_rounds(store, 2, 20, 2)
    assert 1 <= rounds <= 6  # of twelve megas, three at a time at most
    assert {r.vec_id: tuple(r.e) for r in store.rows().collect()} == before
    assert store.megas().where("v = 0").count() == 0
    history = store.history().orderBy("version").collect()
    assert len(history) == rounds + 1 and sum(r.rows for r in history[1:]) == 720 and sum(r.megas_out for r in history) == 12
    assert maintain.recluster_in_rounds(CellStore(spark, str(tmp_path / "none")), 2, 20, 2) == 0
