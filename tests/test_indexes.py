"""Operators without SQL: recall, invariants, round trips, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake import catalog
from quiverlake.operators import cluster as C
from quiverlake.operators import dense
from quiverlake.operators import graph as G
from quiverlake.operators import product as P
from quiverlake.operators import search as S

DATA = "/root/testdata/sf0.001"


def mean_recall(found, truth):
    return S.recall(found, truth, 10).agg(F.avg("recall")).first()[0]


def test_graph_search_recall_filter_and_delete(spark):
    base, asked = catalog.base(spark, DATA), catalog.asked(spark, DATA)
    rows = G.partitioned(base, 4)
    edges = G.build(rows).cache()
    assert mean_recall(G.search(asked, rows, edges, 10, ef=64), S.knn(asked, base, 10)) >= 0.9
    few = rows.withColumn("allowed", F.col("label") < 3)
    got = G.search(asked, few, edges, 10, ef=200)
    assert got.join(base.where("label >= 3"), "vec_id", "left_semi").count() == 0
    gone = base.where("vec_id % 10 = 3").select("vec_id")
    left = G.delete(rows, edges, gone)
    assert left.join(gone.withColumnRenamed("vec_id", "dst"), "dst", "left_semi").count() == 0
    assert left.join(gone.withColumnRenamed("vec_id", "src"), "src", "left_semi").count() == 0


@pytest.mark.parametrize("name, where", [("hnsw_search", "true"), ("hnsw_filtered_search", "label < 3"), ("hnsw_two_hop_search", "label = 2"), ("hnsw_delete_search", "vec_id % 10 <> 3"), ("hnsw_tombstone_search", "vec_id % 10 <> 3"), ("hnsw_insert_search", "true"), ("hnsw_saved_search", "true"), ("hnsw_sq8_search", "true"), ("naive_insert_search", "true")])
def test_registered_graph_queries_have_recall(spark, name, where):
    base, asked = catalog.base(spark, DATA).where(where), catalog.asked(spark, DATA)
    got = catalog.QUERIES[name](spark, DATA).cache()
    assert got.join(base, "vec_id", "left_anti").count() == 0
    recall = mean_recall(got, S.knn(asked, base, 10))
    print(name, "recall", recall)
    assert recall >= 0.9


def test_graph_layers_and_degrees(spark):
    rows = G.partitioned(catalog.base(spark, DATA), 2)
    edges = G.build(rows, m=4).cache()
    most = {r.level: r.n for r in edges.groupBy("level", "part", "src").count().groupBy("level").agg(F.max("count").alias("n")).collect()}
    assert len(most) >= 2 and all(n <= (8 if level == 0 else 4) for level, n in most.items())
    level = {r.vec_id: r.l for r in rows.select("vec_id", G.random_level(m=4).alias("l")).collect()}
    assert all(r.level <= min(level[r.src], level[r.dst]) for r in edges.collect())
    assert edges.select("part", "src").where("level = 0").distinct().count() == rows.count()
    cost = G.costs(G.walks(catalog.asked(spark, DATA), rows, edges, 10, ef=20, m=4)).collect()
    assert all(r.n_parts == 2 and 0 < r.n_hops < r.n_distances < rows.count() for r in cost)


@pytest.mark.parametrize("percent", [50, 10, 2])
@pytest.mark.parametrize("two_hop", [False, True])
def test_filtered_recall_by_selectivity(spark, percent, two_hop):
    base, asked = catalog.base(spark, DATA), catalog.asked(spark, DATA)
    rows = G.partitioned(base, 2)
    ok = S.mask(percent=percent)
    got = G.search(asked, rows.withColumn("allowed", ok), G.build(rows), 10, ef=100, two_hop=two_hop)
    truth = S.knn(asked, base.where(ok), 10)
    assert got.join(base.where(ok), "vec_id", "left_anti").count() == 0
    hits = truth.join(got, ["query_id", "vec_id"]).count()
    assert hits >= 0.9 * truth.count()


def test_deleted_neighbours_are_inherited_and_pruned(spark):
    rows = G.partitioned(catalog.base(spark, DATA), 1)
    edges = G.build(rows, m=4).cache()
    left = G.delete(rows, edges, rows.where("vec_id % 3 = 0").select("vec_id"), m=4).cache()
    assert left.groupBy("level", "src").count().agg(F.max("count")).first()[0] <= 8
    alive = rows.where("vec_id % 3 <> 0")
    found = G.search(catalog.asked(spark, DATA), alive, left, 10, m=4)
    assert mean_recall(found, S.knn(catalog.asked(spark, DATA), alive, 10)) >= 0.85


def test_prune_keeps_nearest_first():
    x = np.array([[1.0, 0], [1.1, 0], [-1, 0]])
    between = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert G.prune((x**2).sum(1), between, 3) == [0, 2]


def test_product_codes_cover_all_dimensions(spark):
    rows = [(i, [0.0] * 9 + [float(i % 16)]) for i in range(64)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>")
    for parts in (8, 12):
        book = P.train(df, parts=parts)
        coded = P.encode(df, book, parts)
        decoded = {r.vec_id: r.decoded for r in P.decode(coded, book).collect()}
        assert all(len(d) == 10 for d in decoded.values()) and len({tuple(d) for d in decoded.values()}) > 1
        query = spark.createDataFrame([(0, [0.0] * 9 + [15.0])], "query_id long, qe array<double>")
        near = P.search(query, coded, book, 4, parts).collect()
        assert abs(np.mean([rows[r.vec_id][1][9] for r in near]) - 15) <= 2


def test_probing_every_cell_is_exact(spark):
    base, asked = catalog.base(spark, DATA), catalog.asked(spark, DATA)
    truth = S.knn(asked, base, 10)
    assert mean_recall(S.two_level_search(asked, *catalog.two_level(spark, DATA), 99, 999, 10), truth) == 1.0


def test_blocks_give_what_a_broadcast_gives(spark):
    a, b = spark.range(50).withColumnRenamed("id", "x"), spark.range(7).withColumnRenamed("id", "y")
    assert sorted(map(tuple, S.paired(a, b, limit=64).collect())) == sorted(map(tuple, S.paired(a, b).collect()))


def test_beyond_the_budget_results_are_the_same(spark, monkeypatch):
    """With no budget for a small side every search takes its other way: pairs in blocks, joins by cell."""
    names = ("knn_l2", "knn_cosine", "radius_join", "assign_1nn", "assign_lambda_prev", "two_level_search", "ivf_flat_search", "insert_assign", "mini_silhouette", "closer_elsewhere", "kmeans_step", "two_level_bad_clusters")
    want = {n: sorted(map(tuple, catalog.QUERIES[n](spark, DATA).collect())) for n in names}
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 1 << 10)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 1 << 10)
    monkeypatch.setattr(S.paired, "__defaults__", (1 << 14,))
    for n in names:
        got = sorted(map(tuple, catalog.QUERIES[n](spark, DATA).collect()))
        assert len(got) == len(want[n])
        assert all(x == pytest.approx(y, abs=2e-6) for x, y in zip(got, want[n])), n


def test_assignment_moves_no_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (1, [9.0, 9.0]), (2, None), (3, [None, 1.0]), (4, [1.0]), (None, [8.0, 8.0])], "vec_id long, e array<double>")
    cells = spark.createDataFrame([(7, [9.0, 9.0]), (5, [0.0, 1.0]), (6, [0.0, 1.0])], "cid long, c array<double>")
    got = C.assign(rows, cells)
    assert sorted(((r.vec_id, r.cid) for r in got.collect()), key=str) == sorted([(1, 5), (1, 7), (2, None), (3, None), (4, None), (None, 7)], key=str)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_partial_sums_equal_plain_means(spark):
    rows = spark.createDataFrame([(i % 3 if i % 5 else None, [float(i), i / 7]) for i in range(50)], "k int, e array<double>").repartition(4)
    got = {r.k: (r.c, r.n) for r in C.means(rows, "k").collect()}
    for k in (0, 1, 2, None):
        own = [(float(i), i / 7) for i in range(50) if (i % 3 if i % 5 else None) == k]
        assert got[k][1] == len(own) and np.allclose(got[k][0], np.mean(own, axis=0), atol=1e-8)


def test_cap_holds_and_keeps_all(spark):
    base, cents = catalog.base(spark, DATA), catalog.cents(spark, DATA)
    got = C.capped(base, cents, 30)
    assert got.groupBy("cid").count().agg(F.max("count")).first()[0] <= 30
    assert got.select("vec_id").distinct().count() == base.count()


def test_caps_cost_little_more_than_the_best(spark):
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(2):
        x, c = rng.normal(size=(9, 2)), rng.normal(size=(3, 2))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        best = min(sum(d[i, a] for i, a in enumerate(own)) for own in itertools.product(range(3), repeat=9) if max(own.count(k) for k in range(3)) <= 3)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>")
        cents = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cid long, c array<double>")
        got = C.capped(rows, cents, 3)
        assert got.groupBy("cid").count().where("count <> 3").isEmpty()
        assert got.agg(F.sum("dist")).first()[0] <= 1.15 * best + 1e-9
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_cap_keeps_all_of_many_equal_rows(spark):
    base, cents = catalog.base(spark, DATA), catalog.cents(spark, DATA)
    one = F.lit([float(x) for x in base.orderBy("vec_id").first().e])
    rows = base.withColumn("e", F.when(F.col("vec_id") % 3 == 1, one).otherwise(F.col("e"))).cache()
    k, n = cents.count(), rows.count()
    cap = -(-n // k) + 5
    got = C.capped(rows, cents, cap)
    assert got.groupBy("cid").count().agg(F.max("count")).first()[0] <= cap
    assert got.count() == got.select("vec_id").distinct().count() == n


def test_cap_without_room_fills_every_cluster(spark):
    base, cents = catalog.base(spark, DATA), catalog.cents(spark, DATA)
    got = C.capped(base, cents, 3)
    assert {r["count"] for r in got.groupBy("cid").count().collect()} == {3} and got.count() == 3 * cents.count()
    assert C.capped(base.limit(0), cents, 3).count() == 0


def test_recluster_keeps_members(spark):
    _, minis, rows = catalog.two_level(spark, DATA)
    assert C.recluster_within(rows, minis, 50).select("vec_id").distinct().count() == rows.count()


def test_streaming_insert_equals_batch(spark, tmp_path):
    from quiverlake.streaming.inserts import stream_insert

    megas, minis, _ = (t.cache() for t in catalog.two_level(spark, DATA))
    source = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 25 = 0").repartition(3)
    source.write.parquet(str(tmp_path / "in"))
    stream_insert(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), megas, minis)
    got = spark.read.parquet(str(tmp_path / "out")).select("vec_id", "mega_id", "mini_id")
    want = C.insert(catalog.asked(spark, DATA).select(F.col("query_id").alias("vec_id"), F.col("qe").alias("e")), megas, minis)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("vec_id", "mega_id", "mini_id").collect()))
