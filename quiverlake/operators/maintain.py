"""Maintenance of two-level indexes: building, pooled re-clustering, buffered inserts, repairs and splits.

An index is one table (vec_id, e, mini_id, mega_id); `levels` derives its centroids.  A
pool of megas is re-clustered in one task, so a pool's size (`pool` rows on average, or a
few megas) bounds the memory of a task; different pools run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance, normalized, uniform
from . import dense
from .cluster import assign, clustered, hashed_init, kmeans, lloyd, means, means_above, member_distances, numbered, saved, silhouettes
from .quantize import decode, encode, train
from .search import knn_graph, paired, probes, top_k

INDEX = ("vec_id", "e", "mini_id", "mega_id")
#: Ids that one pool may give; a pool with more minis is refused.
STRIDE = 1 << 20


def levels(index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(megas, minis, assignment): a mini is the mean of its vectors, a mega of its minis."""
    above = index.groupBy("mini_id").agg(F.min("mega_id").alias("mega_id"))
    minis = dense.local(means(index, "mini_id").join(above, "mini_id"), like=index)
    return means_above(minis), minis, index


def pooled(rows: DataFrame, mini_size: int, minis_of: int, first_id: int = 0, iterations: int = 5) -> DataFrame:
    """An index of rows (vec_id, e, pool): each pool's vectors become minis, its minis megas.  New ids start at first_id."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        x, ok = dense.matrix(table.column("e"))
        x = (x if ok.all() else np.stack(table.column("e").to_pylist()))[order]
        names, mini = np.unique(lloyd(x, mini_size, iterations), return_inverse=True)
        if len(names) > STRIDE:
            raise ValueError(f"a pool gives at most {STRIDE} minis: deal its rows into more pools")
        centres = np.zeros((len(names), x.shape[1]))
        np.add.at(centres, mini, x)
        mega = lloyd(centres / np.bincount(mini)[:, None], minis_of, iterations)
        start = first_id + int(table.column("pool")[0].as_py()) * STRIDE
        ids = np.empty((2, len(x)), np.int64)
        ids[:, order] = start + mini, start + mega[mini]
        return table.select(["vec_id", "e"]).append_column("mini_id", pa.array(ids[0])).append_column("mega_id", pa.array(ids[1]))

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "e", "pool")
    return rows.groupBy("pool").applyInArrow(run, "vec_id long, e array<double>, mini_id long, mega_id long")


def build(rows: DataFrame, mini_size: int, minis_of: int, pool: int, iterations: int = 5) -> DataFrame:
    """An index of all rows: coarse cells of about `pool` rows by distributed k-means, then each cell by itself."""
    cells = hashed_init(rows, max(1, rows.count() // pool))
    dealt = assign(rows.select("vec_id", "e"), kmeans(rows, cells, iterations)).select("vec_id", "e", F.col("cid").alias("pool"))
    return saved(pooled(dealt, mini_size, minis_of, 0, iterations))


def _next_id(index: DataFrame) -> int:
    return int(index.agg(F.coalesce(F.max(F.greatest("mini_id", "mega_id")), F.lit(-1))).first()[0]) + 1


def replaced(index: DataFrame, pools: DataFrame, mini_size: int, minis_of: int, more: DataFrame | None = None) -> DataFrame:
    """The index with the megas of pools (mega_id, pool) re-clustered, each pool by itself; `more` (vec_id, e, pool) joins them."""
    rows = index.join(pools, "mega_id").select("vec_id", "e", "pool")
    rows = rows.unionByName(more.select("vec_id", "e", "pool")) if more is not None else rows
    new = pooled(rows, mini_size, minis_of, _next_id(index))
    return saved(index.join(pools, "mega_id", "left_anti").select(*INDEX).unionByName(new.select(*INDEX)))


def recluster_megas(minis: DataFrame, megas: DataFrame, iterations: int = 1, metric: str = "l2") -> DataFrame:
    """(mini_id, mega_id, dist): minis dealt anew to megas that move to their means; the minis stay."""
    rows = minis.select(F.col("mini_id").alias("vec_id"), F.col("c").alias("e"))
    cells = kmeans(rows, megas.select(F.col("mega_id").alias("cid"), "c"), iterations, metric)
    return assign(rows, cells, metric).select(F.col("vec_id").alias("mini_id"), F.col("cid").alias("mega_id"), "dist")


def recluster(index: DataFrame, mini_size: int, minis_of: int, fast: bool, iterations: int = 5) -> DataFrame:
    """Every mega clustered anew from its vectors, by itself (fast), or the megas in groups of a few."""
    if not fast:
        return recluster_full(index, 3, mini_size, minis_of, iterations)
    pools, _ = numbered(index.select("mega_id").distinct(), "mega_id", name="pool")
    return replaced(index, pools, mini_size, 1 << 30)


def recluster_full(index: DataFrame, megas_of: int, mini_size: int, minis_of: int, iterations: int = 5) -> DataFrame:
    """Megas in groups of about `megas_of`, every group re-clustered from its vectors."""
    megas = levels(index)[0].select(F.col("mega_id").alias("vec_id"), F.col("c").alias("e"))
    cells = hashed_init(megas, max(1, megas.count() // megas_of))
    pools = assign(megas, kmeans(megas, cells, iterations)).select(F.col("vec_id").alias("mega_id"), F.col("cid").alias("pool"))
    return replaced(index, pools, mini_size, minis_of)


def mega_scores(index: DataFrame, metric: str = "l2") -> DataFrame:
    """(mega_id, mse): mean over a mega's minis of the mean distance of members to their mini."""
    _, minis, rows = levels(index)
    each = member_distances(rows.drop("mega_id"), minis, metric).groupBy("mini_id", "mega_id").agg(F.avg("dist").alias("mse"))
    return each.groupBy("mega_id").agg(F.avg("mse").alias("mse"))


def score_change(old: DataFrame, new: DataFrame, metric: str = "l2") -> DataFrame:
    """(mega_id, old_id, dist, old_mse, mse): each mega of an index with the nearest one of an older version, and both scores."""
    before, now = levels(old)[0], levels(new)[0]
    near = assign(now.select("mega_id", F.col("c").alias("e")), before.select(F.col("mega_id").alias("cid"), "c"), metric).select("mega_id", F.col("cid").alias("old_id"), "dist")
    scores = mega_scores(old, metric).select(F.col("mega_id").alias("old_id"), F.col("mse").alias("old_mse"))
    return near.join(scores, "old_id").join(mega_scores(new, metric), "mega_id").select("mega_id", "old_id", "dist", "old_mse", "mse")


def recluster_in_rounds(store, neighbours: int, mini_size: int, minis_of: int) -> int:
    """Each mega of a cell store clustered anew once with its nearest ones, the worst first, many neighbourhoods at a time; returns the number of rounds.

    Megas are scored once.  In a round every mega that is still to do names itself and its
    nearest ones; a neighbourhood whose centre is worse than that of every other one that
    it shares a mega with is clustered anew.  The worst of all always is, so rounds end;
    neighbourhoods that are apart do not wait for one another.  A round writes the cells
    it has changed and no others.
    """
    if store.version < 0:
        return 0
    start, rounds = store.version, 0
    cells = store.megas().select("mega_id", "cell")
    centres = levels(store.rows())[0].select("mega_id", "c").join(mega_scores(store.rows()), "mega_id").join(cells, "mega_id")
    todo = saved(centres.select(F.col("cell").alias("vec_id"), F.col("c").alias("e"), "mse"))
    while not todo.isEmpty():
        near = knn_graph(todo.select("vec_id", "e"), neighbours).select(F.col("query_id").alias("centre"), F.col("vec_id").alias("cell"))
        near = near.unionByName(todo.select(F.col("vec_id").alias("centre"), F.col("vec_id").alias("cell")))
        near = saved(near.join(todo.select(F.col("vec_id").alias("centre"), "mse"), "centre"))
        first = near.groupBy("cell").agg(F.max_by("centre", F.struct("mse", -F.col("centre"))).alias("first"))
        won = near.join(first, "cell").groupBy("centre").agg(F.bool_and(F.col("first") == F.col("centre")).alias("won")).where("won").select("centre")
        taken = near.join(won, "centre").select("cell", F.col("centre").alias("pool"))
        pools = saved(store.megas().join(taken, "cell").select("mega_id", "cell", "pool"))
        rows = store.rows(pools).join(pools.select("mega_id", "pool"), "mega_id")
        store.replace(pools, pooled(rows, mini_size, minis_of))
        todo = saved(todo.join(pools.select(F.col("cell").alias("vec_id")), "vec_id", "left_anti"))
        rounds += 1
    return rounds


def recluster_on_score(index: DataFrame, neighbours: int, mini_size: int, minis_of: int) -> DataFrame:
    """The worst megas and their nearest ones clustered anew, round by round, until all megas have been done."""
    from ..sources.cellstore import CellStore
    from ..sources.indexfiles import scratch

    store = CellStore(index.sparkSession, scratch(index.sparkSession, "cells"))
    store.append(index)
    recluster_in_rounds(store, neighbours, mini_size, minis_of)
    return store.rows()


def merge_buffer(index: DataFrame | None, buffer: DataFrame, n_megas: int, mini_size: int, minis_of: int, pool: int) -> DataFrame:
    """The index with the buffered rows (vec_id, e) merged in; an empty buffer changes nothing.

    Without an index the buffer becomes one.  Else the buffer is dealt into cells of about
    `pool` rows; each pools with its `n_megas` nearest megas, and a mega that several want
    goes to the nearest.
    """
    if buffer.isEmpty():
        return index
    if index is None or index.isEmpty():
        return build(buffer, mini_size, minis_of, pool)
    cells = saved(kmeans(buffer, hashed_init(buffer, max(1, buffer.count() // pool)), 3))
    more = assign(buffer.select("vec_id", "e"), cells).select("vec_id", "e", F.col("cid").alias("pool"))
    megas = levels(index)[0].select("mega_id", F.col("c").alias("e"))
    near = top_k(paired(megas, cells).select("cid", "mega_id", distance("l2", "e", "c").alias("dist")), n_megas, by="cid", id_col="mega_id")
    pools = near.groupBy("mega_id").agg(F.min_by("cid", F.struct("dist", "cid")).alias("pool"))
    return replaced(index, saved(pools), mini_size, minis_of, more)


def fix_boundaries(assignment: DataFrame, minis: DataFrame, bad: DataFrame, neighbours: int, metric: str = "l2") -> DataFrame:
    """(vec_id, mini_id): members of the minis around each bad one, dealt to the nearest centroid of all such sets they are in."""
    own = minis.join(bad.select("mini_id"), "mini_id", "left_semi").select(F.col("mini_id").alias("bad_id"), F.col("c").alias("b"))
    near = top_k(paired(minis.select("mini_id", "c"), own).select("bad_id", "mini_id", distance(metric, "c", "b").alias("dist")), neighbours, by="bad_id", id_col="mini_id").select("bad_id", "mini_id")
    options = near.select("bad_id", F.col("mini_id").alias("from_id")).join(near, "bad_id").select("from_id", "mini_id").distinct().join(minis.select("mini_id", "c"), "mini_id")
    pairs = assignment.select("vec_id", "e", F.col("mini_id").alias("from_id")).join(options, "from_id").select("vec_id", "mini_id", distance(metric, "e", "c").alias("dist"))
    return pairs.groupBy("vec_id").agg(F.min_by("mini_id", F.struct("dist", "mini_id")).alias("mini_id"))


def split_large(assigned: DataFrame, centroids: DataFrame, factor: float = 2.0, iterations: int = 3) -> DataFrame:
    """(vec_id, old_cid, cid): clusters above factor times the average in two; members nearer to another cluster go there.

    A split cluster's halves keep its id and get the next free ones after the largest.
    """
    sizes = assigned.groupBy("cid").agg(F.count("*").alias("n"))
    big = sizes.crossJoin(F.broadcast(sizes.agg(F.avg("n").alias("mean_n")))).where(F.col("n") > factor * F.col("mean_n")).select("cid")
    more = int(centroids.agg(F.coalesce(F.max("cid"), F.lit(-1))).first()[0]) + 1
    rows = assigned.join(big, "cid", "left_semi").select("vec_id", "e", F.col("cid").alias("parent"))
    sides = F.explode(F.array(F.lit(1), F.lit(-1)))
    halves = centroids.join(big, "cid", "left_semi").select(F.col("cid").alias("parent"), "c", sides.alias("side"))
    moved = F.transform("c", lambda x, i: x * (1 + F.col("side") * F.when(i % 2 == 0, 1).otherwise(-1) / F.lit(1024.0)))
    halves = halves.select("parent", F.when(F.col("side") > 0, F.col("parent")).otherwise(F.col("parent") + more).alias("cid"), moved.alias("c"))
    for _ in range(iterations):
        own = rows.join(halves, "parent").groupBy("vec_id").agg(F.min_by("cid", F.struct(distance("l2", "e", "c"), "cid")).alias("cid"))
        new = means(rows.join(own, "vec_id"), "cid").select("cid", F.col("c").alias("new"))
        halves = saved(halves.join(new, "cid", "left").select("parent", "cid", F.coalesce("new", "c").alias("c")))
    others = centroids.join(big, "cid", "left_anti").select("cid", "c")
    return assign(rows, halves.select("cid", "c").unionByName(others)).select("vec_id", F.col("parent").alias("old_cid"), "cid")


def naive_insert(index: DataFrame | None, batch: DataFrame, mini_size: int, minis_of: int, iterations: int = 5, metric: str = "l2", sample: float = 1.0, balance: float = 0.0, cap: int | None = None) -> DataFrame:
    """The index with a batch (vec_id, e) appended: the batch's own minis and their own megas; what was there stays as it is.

    An empty batch changes nothing, and without an index the batch becomes one.
    """
    if batch.isEmpty():
        return index
    first = _next_id(index) if index is not None and not index.isEmpty() else 0
    _, rows = clustered(batch.select("vec_id", "e"), mini_size, iterations, metric, sample, balance, cap)
    rows = saved(rows.select("vec_id", "e", (F.col("cid") + first).cast("long").alias("mini_id")))
    minis = means(rows, "mini_id")
    _, above = clustered(minis.select(F.col("mini_id").alias("vec_id"), F.col("c").alias("e")), minis_of, iterations, metric)
    above = above.select(F.col("vec_id").alias("mini_id"), (F.col("cid") + first).cast("long").alias("mega_id"))
    new = rows.join(F.broadcast(above), "mini_id") if dense.size_of(minis, "c") <= dense.BROADCAST_BYTES else rows.join(above, "mini_id")
    new = new.select(*INDEX)
    return saved(new if index is None else index.select(*INDEX).unionByName(new))


def train_on_sample(rows: DataFrame, share: float, metric: str = "l2", vector: str = "e") -> DataFrame:
    """Parameters of 8-bit codes from the rows whose draw is below `share`; for cosine on vectors of unit length."""
    some = rows.where(uniform(F.col("vec_id")) < share)
    return train(some.withColumn(vector, normalized(F.col(vector))) if metric == "cosine" else some, vector)


def quantized(index: DataFrame, share: float = 1.0, metric: str = "l2") -> tuple[DataFrame, DataFrame]:
    """(parameters, index with codes and, as `e`, what they decode to): every search on it is one on codes."""
    params = train_on_sample(index, share, metric)
    unit = index.withColumn("e", normalized(F.col("e"))) if metric == "cosine" else index
    coded = decode(encode(unit, params), params)
    return params, coded.withColumn("e", F.col("decoded")).drop("decoded")


def naive_insert_codes(index: DataFrame | None, batch: DataFrame, params: DataFrame, mini_size: int, minis_of: int, iterations: int = 5, metric: str = "l2") -> DataFrame:
    """As naive_insert on 8-bit codes: the batch is coded by the index's parameters and clustered as decoded."""
    coded = decode(encode(batch.select("vec_id", "e"), params), params).select("vec_id", F.col("decoded").alias("e"))
    return naive_insert(index, coded, mini_size, minis_of, iterations, metric)


def coded_levels(index: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(megas, minis, assignment) of a quantised index: megas as they are, minis as their codes decode."""
    megas, minis, rows = levels(index)
    minis = decode(encode(minis, params, "c"), params).withColumn("c", F.col("decoded")).drop("decoded", "codes")
    return megas, minis, rows


def report(index: DataFrame, written: int | None = None, metric: str = "l2") -> DataFrame:
    """One row: sizes of megas and minis, their mean errors, and bytes written for each byte of vectors."""
    _, minis, rows = levels(index)
    per = index.groupBy("mega_id").agg(F.count("*").alias("n"), F.count_distinct("mini_id").alias("minis"))
    sizes = per.agg(F.count("*").alias("n_megas"), F.sum("minis").alias("n_minis"), F.sum("n").alias("n_vectors"), F.min("n").alias("min_mega"), F.max("n").alias("max_mega"))
    small = minis.agg(F.min("n").alias("min_mini"), F.max("n").alias("max_mini"), F.round(F.avg("n"), 6).alias("avg_mini"))
    error = mega_scores(index, metric).agg(F.round(F.avg("mse"), 6).alias("avg_mega_mse"), F.round(F.max("mse"), 6).alias("max_mega_mse"))
    own = bytes_of(index)
    spent = F.lit(written).cast("long") if written is not None else F.col("user_bytes")
    return sizes.crossJoin(F.broadcast(small)).crossJoin(F.broadcast(error)).crossJoin(F.broadcast(own)).withColumn("amplification", F.round(spent / F.col("user_bytes"), 6))


def bytes_of(rows: DataFrame, vector: str = "e") -> DataFrame:
    """(user_bytes): vectors as 32-bit floats."""
    return rows.agg(F.coalesce(F.sum(F.size(vector).cast("long") * 4), F.lit(0)).alias("user_bytes"))


def split_megas(index: DataFrame, most: int, mini_size: int, minis_of: int) -> DataFrame:
    """The index with every mega of more than `most` vectors in two, each half clustered into minis anew.

    Both halves get new ids, as do their minis.
    """
    big = index.groupBy("mega_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mega_id")
    megas = levels(index)[0].join(big, "mega_id", "left_semi")
    sides = F.explode(F.array(F.lit(1), F.lit(-1)))
    halves = megas.select("mega_id", "c", sides.alias("side"))
    moved = F.transform("c", lambda x, i: x * (1 + F.col("side") * F.when(i % 2 == 0, 1).otherwise(-1) / F.lit(1024.0)))
    halves, _ = numbered(halves.select("mega_id", "side", moved.alias("c")), "mega_id", "side", name="mini_id")
    halves = saved(halves.select("mega_id", "mini_id", "c"))
    rows = saved(index.join(big, "mega_id", "left_semi").select("vec_id", "e", "mega_id"))
    if rows.isEmpty():
        return index.select(*INDEX)
    for _ in range(3):
        own = _in_group(rows, halves)
        new = means(own.select("mini_id", "e"), "mini_id").select("mini_id", F.col("c").alias("new"))
        halves = saved(halves.join(new, "mini_id", "left").select("mega_id", "mini_id", F.coalesce("new", "c").alias("c")))
    dealt = _in_group(rows, halves).select("vec_id", "e", F.col("mini_id").alias("pool"))
    new = pooled(dealt, mini_size, minis_of, _next_id(index))
    return saved(index.join(big, "mega_id", "left_anti").select(*INDEX).unionByName(new.select(*INDEX)))


def _in_group(rows: DataFrame, minis: DataFrame) -> DataFrame:
    """The rows (vec_id, e, mega_id) with the nearest mini of their own mega."""
    low = dense.few(minis, "mini_id", "c", ("mega_id",))
    if low is not None:
        return dense.nearest_in(rows.select("vec_id", "e", "mega_id"), "mega_id", low, minis.schema["mini_id"].dataType, "l2")
    cost = rows.join(minis.select("mega_id", "mini_id", "c"), "mega_id").withColumn("dist", distance("l2", "e", "c"))
    return cost.groupBy("vec_id", "e", "mega_id").agg(F.min_by(F.struct("mini_id", "dist"), F.struct("dist", "mini_id")).alias("b")).select("vec_id", "e", "mega_id", "b.mini_id", "b.dist")


def fix_boundaries_anew(index: DataFrame, times: int, near_megas: int, near_minis: int, mini_size: int, minis_of: int) -> DataFrame:
    """`times` times: the worst mini and its nearest ones (within its nearest megas) are pooled and clustered anew.

    A mini is worst by the silhouette of its members; minis made on the way are not taken again.
    """
    made = _next_id(index)
    for _ in range(times):
        megas, minis, rows = levels(index)
        cells = minis.select(F.col("mini_id").alias("cid"), "c")
        score = silhouettes(rows.select("vec_id", "e", F.col("mini_id").alias("cid")), cells).groupBy("cid").agg(F.avg("s").alias("s"))
        worst = score.where(F.col("cid") < made).orderBy("s", "cid").limit(1).join(cells, "cid").select(F.lit(0).cast("long").alias("query_id"), F.col("c").alias("qe"))
        near = probes(worst, megas, near_megas, cid="mega_id").select("mega_id")
        picked = minis.join(near, "mega_id", "left_semi").select("mini_id", "c")
        pool = saved(probes(worst, picked, near_minis, cid="mini_id").select("mini_id"))
        if pool.isEmpty():
            break
        first = _next_id(index)
        rows = index.join(pool, "mini_id", "left_semi").select("vec_id", "e", F.lit(0).cast("long").alias("pool"))
        index = saved(index.join(pool, "mini_id", "left_anti").select(*INDEX).unionByName(pooled(rows, mini_size, minis_of, first).select(*INDEX)))
    return index


def subcells(index: DataFrame, mini_size: int) -> DataFrame:
    """(mini_id, sub_id, vec_id, place): minis of at least twice the size in cells of their own, and each member's place by cell."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        own = lloyd(np.stack(pdf["e"].to_numpy()), mini_size, 5) if len(pdf) >= 2 * mini_size else np.zeros(len(pdf), int)
        place = np.empty(len(pdf), np.int64)
        place[np.argsort(own, kind="stable")] = np.arange(len(pdf))
        return pd.DataFrame({"mini_id": pdf["mini_id"], "sub_id": own.astype("int64"), "vec_id": pdf["vec_id"], "place": place})

    return index.select("mini_id", "vec_id", "e").groupBy("mini_id").applyInPandas(run, "mini_id long, sub_id long, vec_id long, place long")
