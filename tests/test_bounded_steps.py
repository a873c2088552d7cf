"""Steps whose memory or work must not grow with the number of queries, probes or inherited links."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quiverlake import catalog
from quiverlake.operators import cluster as C
from quiverlake.operators import dense
from quiverlake.operators import graph as G
from quiverlake.operators import maintain as M
from quiverlake.operators import search as S

DATA = "/root/testdata/sf0.001"


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_probing_every_cell_holds_no_vector_a_pair():
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(300, 64)), rng.normal(size=(3000, 64))
    assert peak_mb(lambda: dense._first(dense.near("l2", c, x), x, c, "l2", None, 3000, dense.slack(x, c))) < 300


def test_probes_need_not_carry_their_query(spark):
    base, cells = catalog.asked(spark, DATA), catalog.cents(spark, DATA)
    slim, full = S.probes(base, cells, 1 << 20, carry=False), S.probes(base, cells, 1 << 20)
    assert slim.columns == ["query_id", "cid", "probe_dist", "probe_rank"]
    assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, full.drop("qe").collect()))


def test_inherited_links_are_compared_with_kept_ones_only():
    x = np.random.default_rng(2).normal(size=(900, 64))
    graph = G.Graph(x, np.zeros(900, int))
    graph.add(np.arange(900))
    assert peak_mb(lambda: graph.drop(np.arange(0, 900, 2))) < 300
    assert not np.isin(graph.links[0][1::2], np.arange(0, 900, 2)).any()


def test_wide_pruning_keeps_what_narrow_pruning_keeps():
    x = np.random.default_rng(3).normal(size=(120, 8))
    d = G.squares(x[None, 1:], x[:1])
    want = G.prune(d[0], ((x[1:, None] - x[None, 1:]) ** 2).sum(-1), 6)
    got = G.prune_many(x, np.arange(1, 120)[None], d, 6)[0]
    assert [i - 1 for i in got if i >= 0] == want


def test_a_tile_is_compared_for_all_its_queries_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    x, calls, one = rng.normal(size=(500, 16)), [], dense.distance
    monkeypatch.setattr(dense, "distance", lambda *a: calls.append(1) or one(*a))
    best = dense.Best(x, 4, "l2")
    best.add(np.arange(500), x)
    assert len(calls) < 10
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = [(q, i) for q in range(500) for i in np.argsort(d[q], kind="stable")[:4].tolist()]
    got = best.rows(np.arange(500)).to_pydict()
    assert list(zip(got["query_id"], got["vec_id"])) == want


def test_neighbours_of_some_rows_and_blocks_give_the_graph(spark, monkeypatch):
    base = catalog.base(spark, DATA).cache()
    want = sorted(map(tuple, S.knn_graph(base, 5).collect()))
    some = base.where("vec_id < 9").select("vec_id")
    assert sorted(map(tuple, S.knn_graph(base, 5, of=some).collect())) == [r for r in want if r[0] < 9]
    monkeypatch.setattr(S, "SELF_BYTES", 0)
    assert sorted(map(tuple, S.knn_graph(base, 5).collect())) == want


def test_expansion_compares_a_frontier_and_not_all_pairs(spark, monkeypatch):
    asked, one = [], S.knn
    monkeypatch.setattr(S, "knn", lambda queries, *a: asked.append(queries.count()) or one(queries, *a))
    assert catalog.QUERIES["graph_expansion"](spark, DATA).count() > 0
    assert asked and max(asked) <= 20


def test_tables_of_packed_codes_are_held_for_some_queries_at_a_time(spark, monkeypatch):
    from quiverlake.operators import quantize as Q

    base, asked = catalog.base(spark, DATA), catalog.asked(spark, DATA)
    p = Q.train_pairwise(base).cache()
    packed = Q.packed(Q.encode_pairwise(base, p)).cache()
    want = sorted(map(tuple, Q.search_packed(asked, packed, p, 10).collect()))
    for name, value in (("TABLES", 3 << 16), ("MADE", 64)):
        monkeypatch.setattr(dense, name, value)
    assert sorted(map(tuple, Q.search_packed(asked, packed, p, 10).collect())) == want


def test_product_codes_are_looked_up_in_tasks(spark, monkeypatch):
    from quiverlake.operators import product as P

    base, asked = catalog.base(spark, DATA), catalog.asked(spark, DATA)
    book = P.train(base, iterations=1).cache()
    coded = P.encode(base, book).cache()
    got = P.search(asked, coded, book, 10)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(dense, "few", lambda *a: None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.search(asked, coded, book, 10).collect()))


def test_rounds_of_joins_keep_no_growing_estimate(spark):
    from quiverlake.operators import descent as D

    base, asked = catalog.base(spark, DATA).where("vec_id < 150").select("vec_id", "e"), catalog.asked(spark, DATA).limit(3)
    links = D.neighbours(base, 4, rounds=1)
    digits = lambda df: len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    visited = [D.search(asked, base, links, [1, 2], 3, ef=16, follow=1, rounds=n)[1] for n in (2, 6)]
    assert digits(visited[1]) <= digits(visited[0]) < 100


def test_larger_tables_have_more_graphs_and_no_larger_ones(spark, monkeypatch):
    made = []
    one = catalog.G.build
    monkeypatch.setattr(catalog.G, "build", lambda rows, *a, **b: made.append(rows.select("part").distinct().count()) or one(rows, *a, **b))
    for name in ("hnsw_costs", "partitioned_hnsw_search"):
        catalog.QUERIES[name](spark, DATA)
    monkeypatch.setattr(catalog, "PART_ROWS", 30)
    for name in ("hnsw_costs", "partitioned_hnsw_search"):
        catalog.QUERIES[name](spark, DATA)
    assert made[:2] == [4, 8] and made[2] == 16 and 8 < made[3] <= 16


def test_effort_is_tuned_on_one_graph(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog.S, "tune_effort", lambda search, *a: seen.append(search(10)._jdf.queryExecution().optimizedPlan().toString()) or 10)
    catalog.QUERIES["ef_tuning"](spark, DATA)
    assert seen[0].count("FlatMapGroupsInPandas") == 1  # the walks alone: no graph is built for an effort


@pytest.mark.parametrize("cells", [984, 5900])
def test_what_an_assignment_holds_does_not_grow_with_the_cells(cells):
    rng = np.random.default_rng(3)
    c, x = rng.normal(size=(cells, 64)), rng.normal(size=(4000, 64))

    def step():
        for a, b in dense._pieces(len(x), cells):
            dense._first(dense.near("l2", c, x[a:b]), x[a:b], c, "l2", None, 1, dense.slack(x[a:b], c))

    assert peak_mb(step) < 32


def test_sums_of_many_groups_are_handed_on_as_one_array():
    sums = {i: (np.full(64, i), i + 1) for i in range(5900)}
    assert peak_mb(lambda: dense.summed(sums, "cid", pa.int64())) < 9  # thrice their bytes
    made = dense.summed(sums, "cid", pa.int64())
    assert made.slice(7, 1).to_pylist() == [{"cid": 7, "sums": [7] * 64, "n": 8}] and made.num_rows == 5900


def test_a_kmeans_step_finds_and_adds_up_in_one_python_pass(spark, monkeypatch):
    base, cents = catalog.base(spark, DATA).select("vec_id", "e"), catalog.cents(spark, DATA)
    passes, one = [], dense.merged_sums
    monkeypatch.setattr(dense, "merged_sums", lambda parts, *a: passes.append(parts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")) or one(parts, *a))
    got = {r.cid: r.c for r in C.kmeans(base, cents, 1).collect()}
    assert passes == [1]
    want = {r.cid: r.c for r in C.means(C.assign(base, cents).where("cid IS NOT NULL"), "cid").collect()}
    assert {k: got[k] for k in want} == want
    monkeypatch.setattr(dense, "few", lambda *a: None)  # centroids that may not travel
    assert {r.cid: r.c for r in C.means_of_nearest(base, cents).collect()} == want


def test_rows_without_a_distance_are_in_no_mean(spark):
    rows = [(0, [0.0, 1.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [9.0, 8.0]), (None, [9.0, 10.0])]
    rows = spark.createDataFrame(rows, "vec_id long, e array<double>")
    cents = spark.createDataFrame([(5, [0.0, 0.0]), (7, [9.0, 9.0]), (8, [99.0, 9.0])], "cid long, c array<double>")
    assert sorted(map(tuple, C.means_of_nearest(rows, cents).collect())) == [(5, [0.0, 1.0], 1), (7, [9.0, 9.0], 2)]
    assert C.means_of_nearest(rows, cents.limit(0)).collect() == C.means_of_nearest(rows.limit(0), cents).collect() == []


def test_a_large_pool_holds_some_distances_at_a_time():
    x = np.random.default_rng(5).normal(size=(12_000, 8))
    peak = peak_mb(lambda: C.lloyd(x, 3, 1))
    assert peak < 40  # 4,096 rows by 4,000 clusters would be 131 MB


def test_exact_distances_are_held_for_some_pairs_at_a_time():
    x = np.random.default_rng(6).normal(size=(40_000, 64))
    row = np.arange(len(x))
    assert peak_mb(lambda: dense.exactly("l2", x, row, x, row[::-1])) < 30


def test_a_pool_is_clustered_in_order_of_id_whatever_the_order_of_its_rows(spark):
    x = np.random.default_rng(7).normal(size=(90, 4))
    order = np.random.default_rng(8).permutation(90)
    rows = spark.createDataFrame([(int(i), x[i].tolist(), 2) for i in order], "vec_id int, e array<double>, pool long")
    got = {r.vec_id: r for r in M.pooled(rows, 9, 3, first_id=11).collect()}
    own = np.unique(C.lloyd(x, 9, 5), return_inverse=True)[1]
    assert [got[i].mini_id for i in range(90)] == (11 + 2 * M.STRIDE + own).tolist()
    assert all(got[i].e == x[i].tolist() for i in range(90))
