"""Index maintenance, product quantisation and tuning: invariants and recall."""

import pytest
from pyspark.sql import functions as F

from quiverlake import catalog
from quiverlake.operators import cluster as C
from quiverlake.operators import maintain as M
from quiverlake.operators import product as P
from quiverlake.operators import search as S

DATA = "/root/testdata/sf0.001"


def recall(found, truth):
    return S.recall(found, truth, 10).agg(F.avg("recall")).first()[0]


@pytest.fixture(scope="module")
def index(spark):
    return M.build(catalog.base(spark, DATA), 20, 4, 200).cache()


def is_index_of(index, rows):
    assert sorted(r.vec_id for r in index.select("vec_id").collect()) == sorted(r.vec_id for r in rows.select("vec_id").collect())
    assert index.groupBy("mini_id").agg(F.count_distinct("mega_id").alias("n")).where("n > 1").count() == 0


def test_build_holds_all_rows_and_full_probing_is_exact(spark, index):
    base, asked = catalog.base(spark, DATA), catalog.asked(spark, DATA)
    is_index_of(index, base)
    megas, minis, rows = M.levels(index)
    found = S.two_level_search(asked, megas, minis, rows.drop("mega_id"), 999, 9999, 10)
    assert recall(found, S.knn(asked, base, 10)) == 1.0


def test_maintenance_keeps_all_rows(spark, index):
    base = catalog.base(spark, DATA)
    is_index_of(M.recluster_full(index, 3, 20, 4), base)
    is_index_of(M.recluster_on_score(index, 2, 20, 4), base)


def test_buffer_merge(spark, index):
    base = catalog.base(spark, DATA)
    new = catalog.vectors(spark, DATA).where("vec_id % 25 = 0").select("vec_id", "e")
    is_index_of(M.merge_buffer(index, new, 2, 20, 4, 200), base.select("vec_id").unionByName(new.select("vec_id")))
    is_index_of(M.merge_buffer(None, new, 2, 20, 4, 200), new)
    assert M.merge_buffer(index, new.where("false"), 2, 20, 4, 200) is index


def test_splits_move_only_members_of_large_clusters(spark):
    rows = spark.createDataFrame([(i, [float(i < 30) * 9 + i / 100, 1.0], 0) for i in range(60)] + [(100 + i, [50.0 + i, 1.0], 1 + i) for i in range(5)], "vec_id long, e array<double>, cid long")
    cents = C.means(rows, "cid").select("cid", "c")
    got = {r.vec_id: (r.old_cid, r.cid) for r in M.split_large(rows, cents).collect()}
    assert set(got) == set(range(60)) and {g[0] for g in got.values()} == {0}
    assert len({got[i][1] for i in range(30)}) == len({got[i][1] for i in range(30, 60)}) == 1 and got[0][1] != got[59][1]


@pytest.mark.parametrize("symmetric", [False, True])
def test_product_codes(spark, symmetric):
    base, asked = catalog.base(spark, DATA), catalog.asked(spark, DATA)
    book = P.train(base, parts=16, codes=32).cache()
    coded = P.encode(base, book, 16)
    error = P.decode(coded, book).select(F.avg(F.expr("aggregate(zip_with(e, decoded, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"))).first()[0]
    assert error < 0.5  # vectors have length 1
    found = P.search(asked, coded, book, 50, 16, symmetric)
    again = S.recall(found.withColumn("rank", F.lit(1)), S.knn(asked, base, 10), 10).agg(F.avg("recall")).first()[0]
    assert again >= (0.6 if symmetric else 0.8)


def test_pruned_edges_are_diverse(spark):
    edges = catalog.QUERIES["rng_prune_edges"](spark, DATA)
    near = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("pos").alias("p")).agg(F.max("n"), F.max("p"), F.count("*")).first()
    assert near[0] <= 8 and near[1] == 0 and near[2] == catalog.base(spark, DATA).count()


def test_routed_graph_search_and_tuning(spark):
    truth = S.knn(catalog.asked(spark, DATA), catalog.base(spark, DATA), 10)
    assert recall(catalog.QUERIES["partitioned_hnsw_search"](spark, DATA), truth) >= 0.9
    assert catalog.QUERIES["ef_tuning"](spark, DATA).first().avg_recall >= 0.95


def test_appended_batches_leave_the_rest_alone(spark):
    rows = catalog.base(spark, DATA).select("vec_id", "e")
    first = M.naive_insert(None, rows.where("vec_id % 2 = 0"), 20, 4)
    both = M.naive_insert(first, rows.where("vec_id % 2 = 1"), 20, 4)
    is_index_of(both, rows)
    assert both.join(first.drop("e"), ["vec_id", "mini_id", "mega_id"], "left_semi").count() == first.count()
    assert M.naive_insert(first, rows.where("false"), 20, 4) is first
    sampled = M.naive_insert(None, rows, 20, 4, sample=0.5, balance=0.001)
    is_index_of(sampled, rows)
    held = M.naive_insert(None, rows, 20, 4, cap=30)
    is_index_of(held, rows)
    assert held.groupBy("mini_id").count().agg(F.max("count")).first()[0] <= 30


def test_large_megas_are_split(spark, index):
    base = catalog.base(spark, DATA)
    most = index.groupBy("mega_id").count().agg(F.max("count")).first()[0]
    got = M.split_megas(index, most - 1, 20, 4)
    is_index_of(got, base)
    kept = index.groupBy("mega_id").count().where(f"count < {most}").select("mega_id")
    assert got.join(kept, "mega_id", "left_semi").count() == index.join(kept, "mega_id", "left_semi").count()
    assert M.split_megas(index, 10**6, 20, 4).count() == index.count()


def test_other_maintenance_keeps_all_rows(spark, index):
    base = catalog.base(spark, DATA)
    is_index_of(M.fix_boundaries_anew(index, 2, 3, 4, 20, 4), base)
    is_index_of(M.recluster(index, 20, 4, fast=True), base)
    cells = M.subcells(index, 5).collect()
    assert len(cells) == base.count()
    big = {r.mini_id for r in index.groupBy("mini_id").count().where("count >= 10").collect()}
    assert {r.mini_id for r in cells if r.sub_id > 0} <= big
    for mini in {r.mini_id for r in cells}:
        own = sorted((r.place, r.sub_id) for r in cells if r.mini_id == mini)
        assert [p for p, _ in own] == list(range(len(own))) and [c for _, c in own] == sorted(c for _, c in own)


def test_index_of_codes_is_near_the_index(spark, index):
    base, asked = catalog.base(spark, DATA), catalog.asked(spark, DATA)
    params, coded = M.quantized(index, 0.5)
    found = S.two_level_search(asked, *M.coded_levels(coded.drop("codes"), params), 99, 999, 10)
    assert recall(found, S.knn(asked, base, 10)) >= 0.9


@pytest.mark.parametrize("name", ["staged_insert", "naive_insert_codes", "recluster_codes"])
def test_registered_maintenance_keeps_all_rows(spark, name):
    got = catalog.QUERIES[name](spark, DATA)
    every = catalog.vectors(spark, DATA) if name == "staged_insert" else catalog.base(spark, DATA)
    is_index_of(got, every)


def test_registered_graph_reports(spark):
    low, high, mean = catalog.QUERIES["graph_degree_stats"](spark, DATA).first()
    assert 1 <= low <= mean <= high <= 32
    assert catalog.QUERIES["hnsw_recall"](spark, DATA).first().avg_recall >= 0.95
