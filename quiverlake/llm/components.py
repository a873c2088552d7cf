"""Connected components of an edge table, by union-find inside partitions and contraction between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_stage, stage_table


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each node's component) of the edges a[i] - b[i]."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):
        parent[x] = parent[parent[x]]  # a parent is never larger, so it is final already
    return nodes, nodes[np.array(parent, dtype=np.int64)] if len(nodes) else nodes


def _forest(batches):
    """Edges of a partition, reduced to one edge for each node and component."""
    kept, new, n = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

    def reduced():
        nodes, roots = union_find(*(np.concatenate([kept[i], *(pair[i] for pair in new)]) for i in (0, 1)))
        apart = nodes != roots
        return nodes[apart], roots[apart]

    for batch in batches:
        new.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
        n += batch.num_rows
        if n > len(kept[0]) + 50_000:  # as many as are kept at least: the work stays in proportion to the edges
            kept, new, n = reduced(), [], 0
    kept = reduced()
    yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], names=["a", "b"])


#: Edges of a partition at least.
EDGES = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the smallest node that it reaches.

    Each round points every node to its smallest neighbour, then to that one's, and
    contracts the edges; the rounds are logarithmic in the longest path.  Only counts
    come to the driver.  Self-loops and repeated edges change nothing.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b")
    left = stage_table(arrow_stage(pairs, _forest, "a long, b long"), "edges")
    labels: DataFrame | None = None
    nodes = 0
    while n := left.count():
        nodes = nodes or n  # a forest has more nodes than edges; every later table is about as large or smaller
        saved = lambda df, name, n=n: stage_table(df.coalesce(-(-n // EDGES)), name)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        near = saved(near, "near")
        step = near.join(near.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select(F.col("a").alias("node"), F.col("q").alias("component"))
        step = saved(step, "step")
        if labels is None:
            labels = step
        else:
            on = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            labels = saved(labels.join(on, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels", nodes)
        a = step.select(F.col("node").alias("a"), F.col("component").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("component").alias("y"))
        moved = left.join(a, "a").join(b, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        left = saved(arrow_stage(moved.repartition(parts, "b"), _forest, "a long, b long"), "edges")
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
