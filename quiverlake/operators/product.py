"""Product quantisation: code books for slices of the dimensions, codes, and search by tables of distances.

The code books are one row (books: slice -> code -> centroid) whose size the parameters
bound.  Coding a vector is one expression without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2, total
from . import dense
from .cluster import hashed_init, means, saved
from .search import paired, top_k


def _slices(v: Column, parts: int) -> Column:
    """All dimensions in `parts` slices; the first ones have one more where the number does not divide."""
    size, more = F.floor(F.size(v) / parts).cast("int"), F.size(v) % parts
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda s: F.slice(v, s * size + F.least(s, more) + 1, size + (s < more).cast("int")))


def _tables(v: Column, parts: int) -> Column:
    """For each slice the distance of the vector to every code."""
    return F.zip_with(_slices(v, parts), F.col("books"), lambda x, book: F.transform(book, lambda c: l2(x, c)))


def _packed(cells: DataFrame, codes: int) -> DataFrame:
    """One row of code books from (cell, c), where a cell is slice * codes + code."""
    books = cells.groupBy(F.floor(F.col("cell") / codes).alias("part")).agg(F.array_sort(F.collect_list(F.struct("cell", "c"))).alias("b"))
    whole = books.agg(F.array_sort(F.collect_list(F.struct("part", "b"))).alias("w"))
    return whole.select(F.transform("w", lambda p: F.transform(p["b"], lambda c: c["c"])).alias("books"))


def train(rows: DataFrame, parts: int = 8, codes: int = 16, iterations: int = 5) -> DataFrame:
    """Code books by k-means in every slice; an unused code keeps its centroid."""
    first = hashed_init(rows, codes).select("cid", F.posexplode(_slices(F.col("c"), parts)).alias("part", "c"))
    cells = first.select((F.col("part") * codes + F.col("cid")).alias("cell"), "c")
    for _ in range(iterations):
        coded = encode(rows, _packed(cells, codes), parts).select(F.posexplode(F.arrays_zip(F.col("codes").alias("code"), _slices(F.col("e"), parts).alias("x"))).alias("part", "p"))
        new = means(coded.select((F.col("part") * codes + F.col("p.code")).cast("long").alias("cell"), F.col("p.x").alias("e")), "cell").select("cell", F.col("c").alias("new"))
        cells = saved(cells.join(new, "cell", "left").select("cell", F.coalesce("new", "c").alias("c")))
    return _packed(cells, codes)


def encode(rows: DataFrame, book: DataFrame, parts: int = 8, vector: str = "e") -> DataFrame:
    """The rows with `codes`: the nearest code of each slice, the lowest on ties."""
    nearest = lambda t: F.array_min(F.transform(t, lambda d, i: F.struct(d.alias("d"), i.alias("i"))))["i"]
    return rows.crossJoin(F.broadcast(book)).withColumn("codes", F.transform(_tables(F.col(vector), parts), nearest)).drop("books")


def decode(rows: DataFrame, book: DataFrame) -> DataFrame:
    both = rows.crossJoin(F.broadcast(book))
    return both.withColumn("decoded", F.flatten(F.zip_with("codes", "books", lambda c, b: F.get(b, c)))).drop("books")


def search(queries: DataFrame, coded: DataFrame, book: DataFrame, k: int, parts: int = 8, symmetric: bool = False) -> DataFrame:
    """k nearest by sums of looked-up distances; symmetric: the query is coded too."""
    if symmetric:
        queries = decode(encode(queries, book, parts, "qe"), book).select("query_id", F.col("decoded").alias("qe"))
    asked = queries.crossJoin(F.broadcast(book)).select(F.col("query_id").cast("long").alias("query_id"), _tables(F.col("qe"), parts).alias("tables"))
    few = dense.few(asked.withColumn("tables", F.flatten("tables")), "query_id", "tables")
    cores = coded.sparkSession.sparkContext.defaultParallelism
    if few is not None and len(few.ids):  # the tables travel, the codes are dealt over all cores
        tables = few.x.reshape(len(few.ids), parts, -1)
        pairs = dense.nearest_coded(few, tables, coded.select("vec_id", "codes").repartition(2 * cores), k)
        return top_k(pairs, k).select("query_id", "rank", "vec_id", "dist")
    pairs = paired(coded.select("vec_id", "codes"), asked)
    return top_k(pairs.select("query_id", "vec_id", total(F.zip_with("codes", "tables", lambda c, t: F.get(t, c))).alias("dist")), k).select("query_id", "rank", "vec_id", "dist")
