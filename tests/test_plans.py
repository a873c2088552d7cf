"""Plans: what is shuffled, pushed down and read."""

import pytest
from pyspark.sql import functions as F

from quiverlake import catalog
from quiverlake.operators import cluster as C
from quiverlake.operators import dense
from quiverlake.operators import maintain as M
from quiverlake.operators import search as S
from quiverlake.plans import inspect as P
from quiverlake.sources import indexfiles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_filters_and_columns_reach_the_scan(spark):
    df = S.knn(catalog.asked(spark, DATA), catalog.base(spark, DATA).where("label in (1, 3, 7) and vec_id between 10 and 99"), 5)
    pushed = " ".join(P.pushed_filters(df))
    assert "GreaterThanOrEqual(vec_id,10)" in pushed and "In(label" in pushed
    assert P.columns_read(catalog.QUERIES["mask_selectivity"](spark, DATA))[0] == {"vec_id"}


def test_exact_search_shuffles_results_alone(spark):
    df = S.knn(catalog.asked(spark, DATA), catalog.base(spark, DATA), 5)
    plan = P.plan_of(df)
    assert P.exchanges(df) == 1 and P.python_stages(df) == 1
    assert plan.index("WindowGroupLimit") < plan.index("MapInArrow")  # each task keeps k rows a query


def test_assignment_and_probing_shuffle_nothing(spark):
    base, cents = catalog.base(spark, DATA), catalog.cents(spark, DATA)
    assert P.exchanges(C.assign(base, cents)) == 0
    assert P.exchanges(S.probes(catalog.asked(spark, DATA), cents, 3)) == 0
    assert P.exchanges(C.silhouettes(C.assign(base, cents).select("vec_id", "e", "cid"), cents)) == 0


def test_partial_sums_meet_before_the_shuffle(spark):
    sums = dense.group_sums(catalog.base(spark, DATA).repartition(3), "label", "e", 1000)
    assert sums.count() <= 3 * 10 and sums.agg(F.sum("n")).first()[0] == catalog.base(spark, DATA).count()
    few = dense.group_sums(catalog.base(spark, DATA).coalesce(1), "label", "e", 1000, most_bytes=1)
    assert few.agg(F.sum("n")).first()[0] == catalog.base(spark, DATA).count()


def test_a_laid_out_index_is_read_where_it_is_probed(spark, tmp_path):
    index = M.build(catalog.base(spark, DATA), 20, 4, 200)
    megas, minis, rows = M.levels(index)
    indexfiles.save(str(tmp_path), {}, {"rows": "mega_id"}, megas=megas, minis=minis, rows=rows)
    found = indexfiles.load(spark, str(tmp_path))[1]
    assert found["rows"].schema["mega_id"].dataType == index.schema["mega_id"].dataType
    one = catalog.asked(spark, DATA).where("query_id = 25")
    df = S.two_level_search(one, found["megas"], found["minis"], found["rows"], 1, 3, 5)
    assert "PartitionFilters: [" in P.plan_of(df) and "mega_id" in P.plan_of(df).split("PartitionFilters: [")[1].split("]")[0]
    assert [r.vec_id for r in df.collect()] == [r.vec_id for r in S.two_level_search(one, megas, minis, rows, 1, 3, 5).collect()]


def test_pairs_beyond_the_budget_are_dealt_on_both_sides(spark):
    many = spark.range(300).select(F.col("id").alias("a"), F.array(F.col("id").cast("double")).alias("e"))
    few = spark.range(60).select(F.col("id").alias("b"), F.array(F.col("id").cast("double")).alias("q"))
    pairs = S.paired(many, few, limit=600)
    assert pairs.count() == pairs.distinct().count() == 300 * 60
    plan = P.plan_of(pairs)
    assert "many__" in plan and "few__" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
