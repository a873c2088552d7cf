"""Packed 2-bit codes against decoded ones, recall of the re-ranked result, and footers against scans."""

import pytest
from pyspark.sql import functions as F

from quiverlake import catalog
from quiverlake.operators import quantize, search
from quiverlake.sources import footers

DATA = "/root/testdata/sf0.001"


def test_packed_search_equals_decoded_search(spark):
    base, asked = catalog.base(spark, DATA).withColumn("e", F.slice("e", 1, 30)), catalog.asked(spark, DATA).withColumn("qe", F.slice("qe", 1, 30))  # no whole number of bytes
    params = quantize.train_pairwise(base).cache()
    coded = quantize.encode_pairwise(base, params)
    packed = quantize.packed(coded)
    assert {(len(r.codes), len(r.tight)) for r in packed.collect()} == {(8, 1)}
    got = quantize.search_packed(asked, packed, params, 10).persist()
    plain = quantize.decode_pairwise(coded, params).select("vec_id", F.col("decoded").alias("e"))
    want = search.knn(asked, plain, 10)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.dist, 9)) for r in df.collect())
    assert key(got) == key(want)
    assert quantize.search_packed(asked, packed.limit(0), params, 10).count() == 0


def test_reranked_recall(spark):
    found = catalog.QUERIES["pairwise2_packed_rerank"](spark, DATA)
    truth = search.knn(catalog.asked(spark, DATA), catalog.base(spark, DATA), 10)
    assert search.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_footers_equal_a_scan_and_read_no_vectors(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows.repartition(5).write.parquet(str(tmp_path / "many"))
    made = footers.table_stats(spark, str(tmp_path / "many"))
    assert tuple(made.first()) == (5, rows.count(), 64)
    assert "FileScan" not in made._jdf.queryExecution().executedPlan().toString()
    mixed = rows.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    mixed.repartition(2).write.parquet(str(tmp_path / "mixed"))
    groups = footers.row_groups(spark, str(tmp_path / "mixed"))
    assert groups.agg(F.sum("n_values")).first()[0] == mixed.agg(F.sum(F.size("embedding"))).first()[0]
    with pytest.raises(Exception, match="no column"):
        footers.row_groups(spark, str(tmp_path / "many"), "other").collect()
