"""Search within a range of ids by a forest of graphs over ranges.

Rows in order of id are cut into leaves of LEAF rows; two neighbouring leaves make a node
of the level above, and so on up to nodes of at most `most` rows (a task builds one node's
graph, so a larger table has more trees and no larger ones).  A range is covered by the
fewest nodes that lie in it, at most two a level and the trees between; each of these
answers by its graph, without a filter.  The one or two leaves that the range cuts are
scanned.  An index has the rows once for each level.

Rows without an id or a vector are in no node; ids are unique.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance
from . import dense, graph
from .cluster import numbered, saved
from .search import top_k

LEAF, MOST = 64, 1 << 16
#: A node's number: its level above this many bits for its place.
PLACE = 26


@dataclass
class RangeIndex:
    """leaves (leaf, low, high): the ids of each leaf; rows (part, vec_id, e) of every node; edges of the nodes' graphs."""

    leaves: DataFrame
    rows: DataFrame
    edges: DataFrame
    levels: int


def build(rows: DataFrame, leaf: int = LEAF, most: int = MOST, m: int = graph.M, ef: int = graph.EF) -> RangeIndex:
    ranked, n = numbered(rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).select("vec_id", "e"), "vec_id", name="rank")
    if n > leaf << PLACE:
        raise ValueError(f"at most {leaf << PLACE} rows: use larger leaves")
    ranked = ranked.withColumn("leaf", F.floor(F.col("rank") / leaf).cast("int"))
    levels = 1
    while leaf << levels <= min(most, max(1, n) * 2 - 1):
        levels += 1
    part = lambda level: (F.lit(level << PLACE) + F.shiftright("leaf", level)).cast("int")
    nodes = ranked.select("vec_id", "e", F.explode(F.array(*map(part, range(levels)))).alias("part"))
    nodes = saved(nodes.select("part", "vec_id", "e"))
    leaves = saved(ranked.groupBy("leaf").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")))
    inner = nodes.where(F.col("part") >= 1 << PLACE)  # leaves are scanned
    return RangeIndex(leaves, nodes, saved(graph.build(inner, m, ef)), levels)


def cover(first: int, last: int, levels: int) -> list[int]:
    """The fewest nodes whose leaves are first .. last - 1, by number."""
    out, level = [], 0
    while first < last and level < levels:
        top = level == levels - 1
        if first & 1 and not top:
            out.append(level << PLACE | first)
            first += 1
        if last & 1 and not top and first < last:
            last -= 1
            out.append(level << PLACE | last)
        if top:
            out += [level << PLACE | i for i in range(first, last)]
            break
        first, last, level = first >> 1, last >> 1, level + 1
    return out


def probes(index: RangeIndex, queries: DataFrame) -> DataFrame:
    """(query_id, part, cut): the nodes of each query's range (query_id, low, high), and the leaves that it cuts."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    few = dense.fetched(asked)
    if few is None:
        raise ValueError("more queries than may travel to the leaves: ask in blocks")
    sent = queries.sparkSession.sparkContext.broadcast(few)

    def counted(batches):
        """For each query the leaves that end before its range, that begin by its end, and that begin before it / end after it."""
        low, high = (sent.value.column(c).to_numpy() for c in ("low", "high"))
        sums = np.zeros((4, len(low)), np.int64)
        for batch in batches:
            begin, end = (np.sort(batch.column(c).to_numpy()) for c in ("low", "high"))
            sums += [np.searchsorted(end, low, "left"), np.searchsorted(begin, high, "right"), np.searchsorted(begin, low, "left"), np.searchsorted(end, high, "right")]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), *map(pa.array, sums)], names=["at", "before", "begun", "whole_from", "ended"])

    names = ("before", "begun", "whole_from", "ended")
    found = index.leaves.select("low", "high").mapInArrow(counted, "at long, before long, begun long, whole_from long, ended long")
    found = found.groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow().sort_by("at")
    out: list[tuple[int, int, bool]] = []
    for query, before, begun, first, last in zip(few.column("query_id").to_pylist(), *(found.column(c).to_pylist() for c in names)):
        if before >= begun:
            continue
        nodes = cover(first, last, index.levels) if first < last else []
        cut = [i for i in {before, begun - 1} if not first <= i < last]
        out += [(query, node, node < 1 << PLACE) for node in nodes] + [(query, i, True) for i in cut]
    return queries.sparkSession.createDataFrame(out, "query_id long, part int, cut boolean")


def search(index: RangeIndex, queries: DataFrame, k: int, ef: int = graph.EF, m: int = graph.M) -> DataFrame:
    """(query_id, rank, vec_id, dist, n_distances) of each query (query_id, qe, low, high): its k nearest rows with low <= vec_id <= high.

    n_distances is what the query has cost in all its nodes.
    """
    probed = saved(probes(index, queries))
    graphs = probed.where("not cut")
    walked = graph.walks(queries.select("query_id", "qe"), index.rows.where(F.col("part") >= 1 << PLACE), index.edges, k, ef, m, graphs)
    walked = walked.select("query_id", "part", "vec_id", "dist", "n_distances")
    cut = probed.where("cut").join(queries.select("query_id", "qe", "low", "high"), "query_id")
    scanned = index.rows.where(F.col("part") < 1 << PLACE).join(cut, "part").where("vec_id between low and high")
    scanned = scanned.select("query_id", "part", "vec_id", distance("l2", "e", "qe").alias("dist"), F.lit(1).cast("long").alias("n_distances"))
    both = saved(walked.unionByName(scanned))
    inner = F.col("part") >= 1 << PLACE
    spent = both.groupBy("query_id", "part").agg(F.when(inner, F.max("n_distances")).otherwise(F.sum("n_distances")).alias("n")).groupBy("query_id").agg(F.sum("n").alias("n_distances"))
    return top_k(both.drop("n_distances"), k).join(spent, "query_id").select("query_id", "rank", "vec_id", "dist", "n_distances")
