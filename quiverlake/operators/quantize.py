"""Scalar quantisation to 8 bits and to 2 bits with a tighter range for groups that fit it: training, codes, search on codes, histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, pairwise_decode, pairwise_encode, pairwise_mask, sq8_decode, sq8_encode
from . import dense
from .search import knn, top_k


def train(rows: DataFrame, vector: str = "e") -> DataFrame:
    """One row (low, width): minimum and range of each dimension."""
    zipped = dense.sides(rows, vector).select(F.posexplode(F.arrays_zip("low", "high")).alias("pos", "v"))  # a row a task and dimension
    sides = zipped.groupBy("pos").agg(F.min("v.low").alias("low"), F.max("v.high").alias("high"))
    packed = sides.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("d"))
    return packed.select(F.transform("d", lambda p: p["low"]).alias("low"), F.transform("d", lambda p: p["high"] - p["low"]).alias("width"))


def encode(rows: DataFrame, params: DataFrame, vector: str = "e") -> DataFrame:
    """The rows with `codes`; the parameters are one row and are broadcast."""
    return rows.crossJoin(F.broadcast(params)).withColumn("codes", sq8_encode(F.col(vector), F.col("low"), F.col("width"))).drop("low", "width")


def decode(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(params)).withColumn("decoded", sq8_decode(F.col("codes"), F.col("low"), F.col("width"))).drop("low", "width")


def search(queries: DataFrame, encoded: DataFrame, params: DataFrame, k: int, metric: str = "l2", symmetric: bool = False) -> DataFrame:
    """k nearest by distance to decoded codes; symmetric: the query is quantised too."""
    if symmetric:
        queries = decode(encode(queries, params, "qe"), params).select("query_id", F.col("decoded").alias("qe"))
    base = decode(encoded, params).select("vec_id", F.col("decoded").alias("e"))
    return knn(queries, base, k, metric)


def rerank(found: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances for rows found on codes, and the k best of them."""
    pairs = found.select("query_id", "vec_id").join(base.select("vec_id", "e"), "vec_id").join(queries.select("query_id", "qe"), "query_id")
    return top_k(pairs.select("query_id", "vec_id", distance(metric, "e", "qe").alias("dist")), k).select("query_id", "rank", "vec_id", "dist")


def histograms(rows: DataFrame, params: DataFrame, bins: int = 512, vector: str = "e") -> DataFrame:
    """(pos, bin, n): equal-width counts of each dimension."""
    parts = rows.crossJoin(F.broadcast(params)).select(F.posexplode(F.arrays_zip(F.col(vector).alias("v"), F.col("low").alias("low"), F.col("width").alias("width"))).alias("pos", "p"))
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("p.v") - F.col("p.low"), F.col("p.width")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return parts.select("pos", place.alias("bin")).groupBy("pos", "bin").agg(F.count("*").alias("n"))


def narrowest(counts: DataFrame, params: DataFrame, share: float, bins: int = 512) -> DataFrame:
    """One row (low, width): for each dimension the narrowest run of bins with `share` of its rows; ties go to the lowest.

    A run reaches to the lower edge of its last bin.  Every expression works on one
    dimension's bins, whose number is a parameter.
    """
    order = Window.partitionBy("pos").orderBy("bin")
    cells = counts.withColumn("upto", F.sum("n").over(order)).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "upto"))).alias("cells"))
    need = F.element_at("cells", -1)["upto"].cast("double") * F.lit(float(share))

    def run(c):
        ends = F.filter("cells", lambda x: x["upto"] - (c["upto"] - c["n"]) >= need)
        return F.when(F.size(ends) > 0, F.struct((F.get(ends, F.lit(0))["bin"] - c["bin"]).alias("wide"), c["bin"].alias("first")))

    best = cells.select("pos", F.array_min(F.transform("cells", run)).alias("b")).crossJoin(F.broadcast(params))
    low, width = F.element_at("low", F.col("pos") + 1), F.element_at("width", F.col("pos") + 1)
    sides = best.select("pos", (low + F.col("b.first") / F.lit(float(bins)) * width).alias("low"), (F.col("b.wide") / F.lit(float(bins)) * width).alias("width"))
    packed = sides.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "width"))).alias("d"))
    return packed.select(F.transform("d", lambda p: p["low"]).alias("low"), F.transform("d", lambda p: p["width"]).alias("width"))


def train_pairwise(rows: DataFrame, tight: float = 0.8, wide: float = 0.95, bins: int = 512, vector: str = "e") -> DataFrame:
    """One row (low, width, tight_low, tight_width): each dimension's ranges for `wide` and for `tight` of the rows."""
    params = train(rows, vector)
    counts = histograms(rows, params, bins, vector)
    inner = narrowest(counts, params, tight, bins).select(F.col("low").alias("tight_low"), F.col("width").alias("tight_width"))
    return narrowest(counts, params, wide, bins).crossJoin(F.broadcast(inner))


def encode_pairwise(rows: DataFrame, params: DataFrame, vector: str = "e") -> DataFrame:
    """The rows with 2-bit `codes` and a `mask`: which groups of four dimensions use the tight range."""
    mask = pairwise_mask(F.col(vector), F.col("tight_low"), F.col("tight_width"))
    both = rows.crossJoin(F.broadcast(params)).withColumn("mask", F.explode(F.array(mask)))  # made once a row, not once for each use
    return both.withColumn("codes", pairwise_encode(F.col(vector), *map(F.col, ("mask", "low", "width", "tight_low", "tight_width")))).drop("low", "width", "tight_low", "tight_width")


def decode_pairwise(rows: DataFrame, params: DataFrame) -> DataFrame:
    both = rows.crossJoin(F.broadcast(params))
    return both.withColumn("decoded", pairwise_decode(*map(F.col, ("codes", "mask", "low", "width", "tight_low", "tight_width")))).drop("low", "width", "tight_low", "tight_width")


def packed(coded: DataFrame) -> DataFrame:
    """(vec_id, codes, tight) of pairwise coded rows: two bits a dimension and one for each four, as bytes."""
    return dense.packed_codes(coded)


def search_packed(queries: DataFrame, packed: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """k nearest by squared L2 to what packed 2-bit codes decode to, by a table of each query for each byte."""
    asked = dense.few(queries.select(F.col("query_id").cast("long").alias("query_id"), "qe"), "query_id", "qe")
    if asked is None:
        raise ValueError("more queries than may travel: ask in blocks")
    one = params.select("low", "width", "tight_low", "tight_width").first()
    arrays = {name: np.array(one[name]) for name in ("low", "width", "tight_low", "tight_width")}
    return top_k(dense.nearest_packed(asked, packed, arrays, k), k).select("query_id", "rank", "vec_id", "dist")
