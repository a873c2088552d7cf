"""Rounds of NN-descent and of beam searches: what travels, what is kept, what stays on disk."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import dense, descent, search

rng = np.random.default_rng(8)
X = (rng.normal(size=(20, 12))[rng.integers(0, 20, 1200)] * 2 + rng.normal(size=(1200, 12))).astype(np.float32)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(2 * i, v.tolist()) for i, v in enumerate(X)], "vec_id long, e array<double>").repartition(3).persist()


def unpack(df, dim=None):
    table = df.toArrow()
    x, ok = dense.unpacked(table, "e", dim)
    return dict(zip(np.array(table.column("vec_id"))[ok].tolist(), x[ok].tolist())), set(table.column("wide").to_pylist())


def test_vectors_travel_as_bytes_and_come_back_as_they_were(spark):
    plain = [(1, [0.5, 2.0]), (2, [1.0, -3.0])]
    odd = [(3, [0.1, 2.0]), (4, [1e300, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [])]
    make = lambda v: dense.packed(spark.createDataFrame(v, "vec_id long, e array<double>").coalesce(1), "e")
    assert unpack(make(plain)) == (dict(plain), {False}) and unpack(make([])) == ({}, set())
    want = dict(plain) | {i: v for i, v in odd if i in (3, 4)}
    assert unpack(make(plain + odd), 2) == (want, {True})
    assert unpack(make(plain).unionByName(make(odd))) == (want, {False, True})


def test_a_walk_is_one_row_of_state(spark, rows, monkeypatch):
    asked = spark.createDataFrame([(i, X[i].tolist()) for i in range(0, 1200, 60)], "query_id long, qe array<double>")
    links = descent.with_reverse(search.knn_graph(rows, 12).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "dist"), 24).persist()
    starts = descent.entries(rows, 64)
    monkeypatch.setattr(descent, "top_k", lambda *a, **b: pytest.fail("rows seen are ordered anew"))
    found, visited = descent.search(asked, rows, links, starts, 5, ef=32)
    want = search.knn(asked, rows, 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.dist) for r in df.collect())
    assert len(set(key(found)) & set(key(want))) >= 95
    counted = visited.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("followed").alias("hops")).collect()
    assert len(counted) == 20 and all(64 <= r.n < 1200 and 8 <= r.hops < r.n for r in counted)
    monkeypatch.setattr(dense, "few", lambda *a: None)  # queries beyond the budget
    assert key(descent.search(asked, rows, links, starts, 5, ef=32)[0]) == key(found)


def test_disk_holds_one_slice_and_no_earlier_rounds(spark, rows, monkeypatch):
    at = spark.conf.get("spark.checkpoint.dir")
    left = lambda rounds: (before := set(os.listdir(at)), descent.neighbours(rows, 8, rounds=rounds, least=0.0, block=32, cuts=1), len(set(os.listdir(at)) - before))[1:]
    whole, n = left(1)
    assert n == left(3)[1] == 1
    monkeypatch.setattr(descent, "LOTS", 1 << 18)
    sent = []
    one = descent.staged_rows
    monkeypatch.setattr(descent, "staged_rows", lambda df, path: sent.append(path) or one(df, path))
    sliced, n = left(1)
    assert n == 1 and sum("links" in p for p in sent) == 1 + -(-2 * 8 * 1200 * (12 * 4 + 64) // (1 << 18)) > 4
    truth = {(r.query_id, r.vec_id) for r in search.knn_graph(rows, 5).collect()}
    share = [len(truth & {(r.src, r.dst) for r in links.collect()}) for links in (whole, sliced)]
    assert share[1] >= share[0] > 0.3 * len(truth) and sliced.groupBy("src").count().agg(F.max("count")).first()[0] == 8
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
