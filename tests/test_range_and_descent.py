"""Graphs over ranges of ids, and one graph over a whole table: covers, recall, costs, and plans without pair tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import descent, rangegraph, search


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] * 2 + rng.normal(size=(2000, 16))
    rows = spark.createDataFrame([(int(3 * i), v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>").repartition(4).persist()
    asked = [(int(i), x[i].tolist(), int(lo), int(lo + n)) for i, (lo, n) in enumerate(zip(rng.integers(0, 2500, 45), [60, 600, 3000] * 15))]
    return rows, spark.createDataFrame(asked, "query_id long, qe array<double>, low long, high long").persist()


def test_covers_are_exact_and_small():
    for levels in (1, 3, 6):
        for first in range(0, 37):
            for last in range(first, 38):
                nodes = rangegraph.cover(first, last, levels)
                leaves = [i for n in nodes for i in range((n & (1 << 26) - 1) << (n >> 26), ((n & (1 << 26) - 1) + 1) << (n >> 26))]
                assert sorted(leaves) == list(range(first, last))
                assert len(nodes) <= 2 * levels + (last - first >> levels - 1)


def truth_of(rows, asked, k):
    pairs = search.paired(rows, asked).where("vec_id between low and high").select("query_id", "vec_id", search.distance("l2", "e", "qe").alias("dist"))
    return search.top_k(pairs, k)


def test_range_search_finds_what_an_exact_scan_finds(spark, table):
    rows, asked = table
    index = rangegraph.build(rows, leaf=32, most=512)
    got = rangegraph.search(index, asked, 10, ef=64).persist()
    want = truth_of(rows, asked, 10).persist()
    share = search.recall(got, want, 10).join(asked, "query_id").groupBy((F.col("high") - F.col("low")).alias("width")).agg(F.sum("hits").alias("hits")).collect()
    total = {r.width: r.n for r in want.join(asked, "query_id").groupBy((F.col("high") - F.col("low")).alias("width")).agg(F.count("*").alias("n")).collect()}
    assert len(share) == 3 and all(r.hits >= 0.95 * total[r.width] for r in share)
    cost = {r.query_id: r.n_distances for r in got.select("query_id", "n_distances").distinct().collect()}
    assert all(0 < c for c in cost.values()) and np.mean(list(cost.values())) < 1000  # of two thousand rows
    inside = got.join(asked, "query_id").where("vec_id < low or vec_id > high")
    assert inside.count() == 0
    none = asked.withColumn("low", F.lit(10_000)).withColumn("high", F.lit(20_000))
    assert rangegraph.search(index, none, 10).count() == 0
    inner = asked.withColumn("low", F.lit(7)).withColumn("high", F.lit(8))  # between two ids of one leaf
    assert rangegraph.search(index, inner, 10).count() == 0
    assert index.rows.groupBy("part").count().agg(F.max("count")).first()[0] <= 512


def test_descent_and_bulk_search(spark, table):
    rows, asked = table
    links = descent.neighbours(rows, 15, block=64, cuts=2).persist()
    exact = search.knn_graph(rows, 10).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"))
    assert links.join(exact, ["src", "dst"], "left_semi").count() >= 0.9 * exact.count()
    assert links.groupBy("src").count().agg(F.max("count")).first()[0] <= 15 and links.where("src = dst").isEmpty()
    both = descent.with_reverse(links, 30).persist()
    found, visited = descent.search(asked, rows, both, descent.entries(rows), 10, ef=64)
    truth = search.knn(asked.select("query_id", "qe"), rows, 10)
    assert search.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.95
    spent = visited.groupBy("query_id").agg(F.count("*").alias("distances"), F.count_if("followed").alias("hops")).agg(F.avg("distances"), F.avg("hops"), F.count_if(F.col("hops") > 300)).first()
    assert spent[0] < 1500 and spent[1] >= 8 and visited.count() == visited.select("query_id", "vec_id").distinct().count()
    assert descent.neighbours(rows.limit(0), 5).count() == 0 and descent.neighbours(rows.limit(1), 5).count() == 0


def test_no_pair_table_is_planned(table):
    rows, _ = table
    for made in (search.knn_graph(rows, 5), search.within_factor(rows.selectExpr("vec_id as query_id", "e as qe"), rows, 1.2)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_queries_beyond_the_budget_meet_the_base_in_blocks(table, monkeypatch):
    from quiverlake.operators import dense

    rows, asked = table
    want = sorted(map(tuple, search.knn(asked.select("query_id", "qe"), rows, 7).collect()))
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 3000)
    got = search.knn(asked.select("query_id", "qe"), rows, 7)
    assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString().replace("FlatMapCoGroups", "CoGroup")
    assert sorted(map(tuple, got.collect())) == want


def test_draws_depend_on_all_bits(spark):
    from quiverlake.functions.vectors import uniform

    ids = spark.createDataFrame([(i + (j << s),) for i in range(64) for j in range(8) for s in (20, 32, 45, 58)], "id long").distinct()
    drawn = ids.select(uniform(F.col("id")).alias("u")).agg(F.count_distinct("u").alias("n"), F.count("*").alias("all"), F.avg("u").alias("mean"), F.stddev("u").alias("sd")).first()
    assert drawn.n == drawn["all"] and abs(drawn.mean - 0.5) < 0.04 and abs(drawn.sd - 12**-0.5) < 0.03
    step = spark.range(0, 1 << 32, 1 << 20).select(uniform(F.col("id")).alias("u"))  # ids that differ above the 20th bit
    assert step.distinct().count() == 4096 and 0.1 < step.where("u < 0.2").count() / 4096 < 0.3


def test_numbers_follow_an_order(spark):
    from quiverlake.operators.cluster import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    made, n = numbered(rows, F.desc("x"), name="no", first=5)
    assert n == 1000 and made.where(F.col("no") != 5 + 999 - F.col("x")).isEmpty() and made.count() == 1000
    assert numbered(rows.limit(0), "x")[1] == 0


def test_a_pool_of_too_many_minis_is_refused(spark, monkeypatch):
    from quiverlake.operators import maintain

    monkeypatch.setattr(maintain, "STRIDE", 2)
    rows = spark.createDataFrame([(i, [float(i), 0.0], 0) for i in range(40)], "vec_id long, e array<double>, pool long")
    with pytest.raises(Exception, match="more pools"):
        maintain.pooled(rows, 4, 4).collect()


def test_duplicates_compare_whole_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 3.0]), (4, None), (5, None), (6, [1.0, 2.0]), (7, [])], "vec_id long, e array<double>")
    assert [tuple(r) for r in search.duplicates(rows).collect()] == [(1, 3)]
