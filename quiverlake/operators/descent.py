"""One neighbour graph over a whole table by rounds of joins, and searches of many queries on it by rounds of joins.

`neighbours` is NN-descent.  Rows are cut by random hyperplane trees into blocks of bounded
size a few times, and each row's nearest ones in its blocks are its first neighbours.  In
each round a row meets the neighbours of its neighbours (new links only, and reverse links
of bounded number), in lots: a row's neighbourhood is at most 2 k vectors, whose pairs are
compared by one matrix product, those of many rows at a time.  No table of pairs of rows is
ever made, and no lot grows with the table.  It ends when few links have changed, or after
`rounds`.  The vectors of a round's lots travel as floats where they are floats, in slices
of at most about LOTS bytes one after another, and what a slice has shuffled is deleted
before the next: disk holds the links twice and one slice, whatever the rounds.

`search` walks such a graph for all queries at once: each round follows the nearest links
that a query has not followed, by a join with the links and one with the vectors; each
query is one row with a bounded beam and the ids that it has seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance, uniform
from ..sources.indexfiles import removed, scratch, staged_rows
from . import dense
from .cluster import unsized
from .search import top_k

LINKS = "src long, dst long, dist double"
#: Rows of a first block, and times that rows are cut into blocks.
BLOCK, CUTS = 256, 3
#: Bytes of vectors that a round's lots shuffle at a time, and distances that a task holds of them.
LOTS, PAIRED = 2 << 30, 1 << 18


def _best(links: DataFrame, k: int) -> DataFrame:
    """Each row's k nearest links, each once; `new` says that a link has not met others yet.  One shuffle, by row."""
    once = links.repartition("src").groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.bool_and("new").alias("new"))
    return top_k(once, k, by="src", id_col="dst").drop("rank")


def _links(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(dist, pa.float64())], names=["src", "dst", "dist"])


def _nearest_in(x: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """Links of each row of one block to its k nearest others there."""
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0)
    d[ids[:, None] == ids[None]] = np.inf
    k = min(k, len(ids) - 1)
    at = np.argpartition(d, k - 1, 1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
    row = np.repeat(np.arange(len(ids)), at.shape[1])
    at = at.ravel()
    dist = ((x[row] - x[at]) ** 2).sum(1)
    ok = np.isfinite(d[row, at])
    return _links(ids[row[ok]], ids[at[ok]], dist[ok])


def _blocks(rows: DataFrame, n: int, dim: int, block: int, seed: int) -> DataFrame:
    """rows with a `block`: sides of as many random directions as halve n rows to `block`, about their means; larger blocks are dealt out by id."""
    spark, bits = rows.sparkSession, max(0, int(np.ceil(np.log2(max(1, n) / block))))
    if not bits:
        return rows.withColumn("block", F.lit(0).cast("long"))
    turn = np.random.default_rng(seed).normal(size=(dim, bits))
    sent = spark.sparkContext.broadcast(turn)

    def sides(batches):
        for batch in batches:
            x, ok = dense.unpacked(batch, "e", dim)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array((x[ok] @ sent.value).ravel()), bits).cast(pa.list_(pa.float64()))], names=["p"])

    projected = rows.select("e", "wide").mapInArrow(sides, "p array<double>")
    middle = np.array(projected.agg(*(F.percentile_approx(F.col("p")[i], 0.5, 1000).alias(f"m{i}") for i in range(bits))).first())
    about = spark.sparkContext.broadcast((turn, middle, 1 << np.arange(bits)))

    def codes(batches):
        for batch in batches:
            x, ok = dense.unpacked(batch, "e", dim)
            turn, middle, digits = about.value
            own = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array((x[ok] @ turn > middle) @ digits, pa.int64())], names=[*own.schema.names, "code"])

    cut = rows.mapInArrow(codes, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, code long")
    sizes = cut.groupBy("code").agg(F.ceil(F.count("*") / (2 * block)).alias("lots"))
    return cut.join(sizes, "code").withColumn("block", F.xxhash64("code", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("lots")))).drop("code", "lots")


def _met(x: np.ndarray, centre: np.ndarray, ids: np.ndarray, new: np.ndarray, worst: np.ndarray):
    """Links nearer than a row's worst among the rows of each centre, where at least one of the two is new; rows are in order of centre."""
    first = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
    size = np.diff(np.append(first, len(centre)))
    wide = int(size.max())
    step = max(1, PAIRED // (wide * wide))
    for a in range(0, len(first), step):
        n, at = size[a : a + step], first[a]
        some = slice(at, at + int(n.sum()))
        group = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(group)) - np.repeat(first[a : a + step] - at, n)
        v, fresh, most, there = np.zeros((len(n), wide, x.shape[1])), np.zeros((len(n), wide), bool), np.full((len(n), wide), -np.inf), np.zeros((len(n), wide), np.int64)
        v[group, place], fresh[group, place], most[group, place], there[group, place] = x[some], new[some], worst[some], np.arange(some.start, some.stop)
        square = (v * v).sum(2)
        d = square[:, :, None] + square[:, None] - 2 * v @ v.transpose(0, 2, 1)
        real = np.arange(wide) < n[:, None]
        once = np.triu(real[:, :, None] & real[:, None], 1) & (fresh[:, :, None] | fresh[:, None])
        g, i, j = np.nonzero(once & (d <= np.maximum(most[:, :, None], most[:, None])))
        src, dst = there[g, i], there[g, j]
        apart = x[src] - x[dst]
        dist = np.einsum("ij,ij->i", apart, apart)
        one, other = dist < worst[src], dist < worst[dst]
        yield np.concatenate([ids[src[one]], ids[dst[other]]]), np.concatenate([ids[dst[one]], ids[src[other]]]), np.concatenate([dist[one], dist[other]])


def _lots(dim: int):
    """For rows (centre, vec_id, new, worst, e, wide) sorted by centre: the links that each centre's rows offer one another."""

    def run(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None or not left.num_rows else [left, batch]).combine_chunks()
            centre = table.column("centre").to_numpy()
            end = int(np.searchsorted(centre, centre[-1])) if len(centre) else 0  # the last centre may go on
            yield from offered(table.slice(0, end))
            left = table.slice(end).combine_chunks().to_batches()[0] if len(centre) else None
        if left is not None:
            yield from offered(pa.Table.from_batches([left]))

    def offered(table):
        if not table.num_rows:
            return
        x, ok = dense.unpacked(table, "e", dim)
        centre, ids, new, worst = (table.column(c).to_numpy() for c in ("centre", "vec_id", "new", "worst"))
        order = np.lexsort((~new, ids, centre))
        order = order[ok[order]]
        once = np.concatenate([[True], (centre[order][1:] != centre[order][:-1]) | (ids[order][1:] != ids[order][:-1])])[: len(order)]
        order = order[once]
        if len(order):
            for found in _met(x[order], centre[order], ids[order], new[order], worst[order]):
                yield _links(*found)

    return run


def neighbours(rows: DataFrame, k: int, rounds: int = 8, least: float = 0.002, block: int = BLOCK, cuts: int = CUTS) -> DataFrame:
    """(src, dst, dist): about the k nearest others of each row (vec_id, e) by squared L2; ids are unique."""
    spark = rows.sparkSession
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "e")
    one, n = rows.select(F.size("e")).first(), rows.count()
    dim = int(one[0]) if one else 0
    kept = scratch(spark, "vectors")
    slim = staged_rows(dense.packed(rows, "e"), kept)
    size = dim * (4 if slim.where("wide").isEmpty() else 8) + 64

    def first(table: pa.Table) -> pa.Table:
        x, ok = dense.unpacked(table, "e", dim)
        return pa.Table.from_batches([_nearest_in(x[ok], table.column("vec_id").to_numpy()[ok], k)])

    made = [_blocks(slim, n, dim, block, seed).groupBy("block").applyInArrow(first, LINKS) for seed in range(cuts)]
    links = made[0]
    for more in made[1:]:
        links = links.unionByName(more)
    at = scratch(spark, "links")
    links = staged_rows(_best(links.withColumn("new", F.lit(True)), k), at)
    slices = max(1, -(-2 * k * n * size // LOTS))
    for _ in range(rounds):
        back = Window.partitionBy("dst").orderBy(F.desc("new"), F.xxhash64("src", "dst"))  # any k of a much linked row's reverse links
        reverse = links.withColumn("r", F.row_number().over(back)).where(F.col("r") <= k).select(F.col("dst").alias("centre"), F.col("src").alias("vec_id"), "new")
        around = links.select(F.col("src").alias("centre"), F.col("dst").alias("vec_id"), "new").unionByName(reverse)
        around = around.withColumn("any", F.max("new").over(Window.partitionBy("centre"))).where("any").drop("any")
        held = scratch(spark, "around")
        around = staged_rows(around, held) if slices > 1 else around
        paths, after = [at], links.withColumn("new", F.lit(False))
        for number in range(slices):
            some = around.where(F.pmod(F.xxhash64("centre"), F.lit(slices)) == number) if slices > 1 else around
            worst = after.groupBy(F.col("src").alias("vec_id")).agg(F.when(F.count("*") < k, F.lit(float("inf"))).otherwise(F.max("dist")).alias("worst"))
            lots = some.join(slim.join(worst, "vec_id"), "vec_id").select("centre", "vec_id", "new", "worst", "e", "wide")
            offered = lots.repartition("centre").sortWithinPartitions("centre").mapInArrow(_lots(dim), LINKS).withColumn("new", F.lit(True))
            paths.append(scratch(spark, "links"))
            after = staged_rows(_best(after.unionByName(offered), k), paths[-1])
            if number:
                removed(spark, paths[-2])
        removed(spark, at, *[held] * (slices > 1))
        links, at = after, paths[-1]
        if links.where("new").count() <= least * n * k:
            break
    removed(spark, kept)
    return links.select("src", "dst", "dist")


def with_reverse(links: DataFrame, most: int) -> DataFrame:
    """Links both ways, each row's `most` nearest."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()
    return top_k(both, most, by="src", id_col="dst").drop("rank")


def entries(rows: DataFrame, n: int = 256) -> list[int]:
    """Ids of n rows with the smallest draws, for walks to begin at.

    A graph of near links falls apart where the rows lie in clusters; a cluster of a share
    s of the rows holds one of the n with probability 1 - (1 - s)^n.
    """
    return [r.vec_id for r in rows.select("vec_id").orderBy(uniform(F.col("vec_id")), "vec_id").limit(n).collect()]


def _measured(queries: DataFrame, rows: DataFrame):
    """A function from pairs (query_id, vec_id) to those with their distance; the queries travel if they fit the budget."""
    few = dense.few(queries, "query_id", "qe")
    if few is None:
        return lambda pairs: pairs.join(rows, "vec_id").join(queries, "query_id").select("query_id", "vec_id", distance("l2", "e", "qe").alias("dist"))
    shared = rows.sparkSession.sparkContext.broadcast(few)

    def run(batches):
        q = shared.value
        for batch in batches:
            asked, ids = (batch.column(c).to_numpy() for c in ("query_id", "vec_id"))
            x, ok = dense.unpacked(batch, "e", q.x.shape[1])
            of = np.minimum(np.searchsorted(q.ids, asked), max(0, len(q.ids) - 1))
            on = np.flatnonzero(ok & (q.ids[of] == asked)) if len(q.ids) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(asked[on]), pa.array(ids[on]), pa.array(dense.exactly("l2", x, on, q.x, of[on]))], names=["query_id", "vec_id", "dist"])

    slim = staged_rows(dense.packed(rows.select("vec_id", "e"), "e"), scratch(rows.sparkSession, "vectors"))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # pairs are few bytes and much work
    return lambda pairs: pairs.repartition(tasks, "vec_id").join(slim, "vec_id").select("query_id", "vec_id", "e", "wide").mapInArrow(run, dense.FOUND)


def search(queries: DataFrame, rows: DataFrame, links: DataFrame, starts: list[int], k: int, ef: int = 64, follow: int = 8, rounds: int = 32) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, vec_id, dist), visited (query_id, vec_id, dist, round, followed)): beam search of all queries (query_id, qe) from a few rows.

    A round follows each query's `follow` nearest rows among its ef nearest that it has not
    followed; it ends when no query has any.  A query is a row of the walks' state: its beam
    (dist, vec_id, done), what it follows next, has followed and has seen.  What it has seen
    has a row each in `visited`: its rows are the distances taken, its followed rows the hops.
    """
    spark, rows = queries.sparkSession, rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "e")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "qe")
    take, seen_at, at = _measured(asked, rows), scratch(spark, "visited"), scratch(spark, "walks")
    out = staged_rows(links.groupBy(F.col("src").alias("vec_id")).agg(F.collect_list("dst").alias("to")), scratch(spark, "lists"))

    def begun(beam: DataFrame) -> DataFrame:
        """The state with what its next round follows marked as done."""
        beam = beam.withColumn("front", F.slice(F.transform(F.filter("beam", lambda r: ~r["done"]), lambda r: r["vec_id"]), 1, follow))
        done = F.transform("beam", lambda r: F.struct(r["dist"].alias("dist"), r["vec_id"].alias("vec_id"), (r["done"] | F.array_contains("front", r["vec_id"])).alias("done")))
        return beam.select("query_id", done.alias("beam"), "front", F.concat("followed", "front").alias("followed"), "seen")

    def grouped(found: DataFrame) -> DataFrame:
        fresh = F.struct("dist", "vec_id", F.lit(False).alias("done"))
        return found.groupBy("query_id").agg(F.collect_list(fresh).alias("fresh"), F.collect_list("vec_id").alias("more"))

    none = F.array().cast("array<long>")
    met = staged_rows(take(asked.select("query_id", F.explode(F.array(*map(F.lit, starts)).cast("array<long>")).alias("vec_id"))), f"{seen_at}/round=0")
    state = grouped(met).select("query_id", F.slice(F.array_sort("fresh"), 1, ef).alias("beam"), none.alias("followed"), F.col("more").alias("seen"))
    state = staged_rows(begun(state), at)
    for number in range(1, rounds + 1):
        front = state.where(F.size("front") > 0)
        if front.isEmpty():
            break
        led = front.select("query_id", F.explode("front").alias("vec_id")).join(out, "vec_id").groupBy("query_id").agg(F.flatten(F.collect_list("to")).alias("to"))
        led = led.join(state.select("query_id", "seen"), "query_id").select("query_id", F.explode(F.array_except("to", "seen")).alias("vec_id"))
        new = grouped(staged_rows(take(led), f"{seen_at}/round={number}"))
        empty = lambda c: F.coalesce(c, F.array().cast(new.schema[c].dataType))
        both = state.join(new, "query_id", "left").withColumn("beam", F.slice(F.array_sort(F.concat("beam", empty("fresh"))), 1, ef)).withColumn("seen", F.concat("seen", empty("more")))
        before, at = at, scratch(spark, "walks")
        state = staged_rows(begun(both), at)
        removed(spark, before)
    best = state.select("query_id", F.posexplode(F.slice("beam", 1, k)).alias("pos", "r")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.dist").alias("dist"))
    hops = unsized(state.select("query_id", F.explode("followed").alias("vec_id"), F.lit(True).alias("now")))
    visited = unsized(spark.read.schema(f"{dense.FOUND}, round int").parquet(seen_at))
    return best, visited.join(hops, ["query_id", "vec_id"], "left").select("query_id", "vec_id", "dist", "round", F.coalesce("now", F.lit(False)).alias("followed"))
