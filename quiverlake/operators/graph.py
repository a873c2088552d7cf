"""Graph search: layered neighbour graphs per partition, pruned for diversity, searched by beam.

A partition's graph is built in one task from the partition's rows; partitions are bounded
by their number or by coarse cells (`routed`), and one of more than MOST_ROWS rows is
refused.  A node's level is drawn from its id; nodes are added in batches, no larger than
the graph they meet: a greedy walk on the layers above a node's level, a beam on each
layer below, a diverse choice among what that and the batch itself offer, and links both
ways that are chosen anew where a neighbour is full.

Edges are a table (part, level, src, pos, dst, dist): saving is writing Parquet, a node
without edges is found by its level alone.  Distances are squared L2.  A partition with no
rows, or whose rows are all excluded, gives nothing; equal vectors are linked like others,
ties go to the smaller id; rows that repeat an id are one node (the first).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import uniform
from . import dense
from .search import paired, probes, top_k

EDGES = "part int, level int, src long, pos int, dst long, dist double"
WALKED = "part int, query_id long, vec_id long, dist double, n_distances long, n_hops long"
M, EF = 16, 64


def partitioned(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))


def routed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with the nearest coarse cell (cid, c) as their partition."""
    from .cluster import assign

    return assign(rows, cells).withColumn("part", F.col("cid").cast("int")).drop("cid", "dist")


def random_level(id_col: str = "vec_id", m: int = M) -> Column:
    """Level of a node: l or more with probability m^-l."""
    return F.floor(-F.ln(uniform(F.col(id_col))) / F.ln(F.lit(float(m)))).cast("int")


def prune(dist_to: np.ndarray, between: np.ndarray, most: int, alpha: float = 1.0) -> list[int]:
    """Indices to keep, nearest first: one goes if a kept one is nearer to it than the source is."""
    kept: list[int] = []
    gone = np.zeros(len(dist_to), bool)
    for i in np.argsort(dist_to, kind="stable"):
        if len(kept) == most:
            break
        if not gone[i]:
            kept.append(int(i))
            gone |= alpha * between[i] < dist_to
    return kept


def squares(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x (rows, n, dim) to its row of q."""
    return ((x - q[:, None]) ** 2).sum(2)


def prune_many(x: np.ndarray, nodes: np.ndarray, d: np.ndarray, most: int, alpha: float = 1.0, step: int = 256) -> np.ndarray:
    """As `prune` for many sources at once: candidates (sources by n, -1 for none) with their distances; kept ones, nearest first."""
    out = np.full((len(nodes), most), -1)
    for a in range(0, len(nodes), step):
        own, dist = nodes[a : a + step], np.where(nodes[a : a + step] < 0, np.inf, d[a : a + step])
        order = np.lexsort((own, dist))
        own, dist = np.take_along_axis(own, order, 1), np.take_along_axis(dist, order, 1)
        v = x[own]
        square = (v * v).sum(2)
        whole = own.shape[1] <= 4 * most  # else only what is kept is compared with the others
        between = square[:, :, None] + square[:, None] - 2 * v @ v.transpose(0, 2, 1) if whole else None
        gone, row = ~np.isfinite(dist), np.arange(len(own))
        for k in range(min(most, own.shape[1])):
            at = (~gone).argmax(1)
            there = ~gone[row, at]
            if not there.any():
                break
            out[a + row[there], k] = own[row[there], at[there]]
            to = between[row, at] if whole else square + square[row, at][:, None] - 2 * (v @ v[row, at][:, :, None])[:, :, 0]
            gone |= there[:, None] & (alpha * to < dist)
            gone[row, at] = True
    return out


#: Open nodes that a walk follows at a time, nodes added at a time, and distances that a step of the walks holds.
FOLLOWED, ADDED, HELD = 4, 256, 1 << 22


class Graph:
    """One partition's layers over the rows of a matrix, whose numbers name the nodes.

    Links are a matrix for each layer (-1 is none).  Many walks go on in step: each step
    follows the nearest open nodes of all queries with a few array operations, so neither
    a query nor a link is a turn of a Python loop.
    """

    def __init__(self, x: np.ndarray, level: np.ndarray, m: int = M, ef: int = EF, alpha: float = 1.0):
        self.x, self.level, self.m, self.ef, self.alpha = x, level, m, ef, alpha
        self.links = [np.full((len(x), self._most(k)), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.inside = np.zeros(len(x), bool)
        self.entry = -1

    def _most(self, level: int) -> int:
        return 2 * self.m if level == 0 else self.m

    def place(self, nodes: Iterable[int]) -> None:
        """Nodes that are in the graph from now on."""
        nodes = np.asarray(list(nodes), np.int64)
        if len(nodes):
            self.inside[nodes] = True
            self._enter()

    def _enter(self) -> None:
        there = np.flatnonzero(self.inside)
        self.entry = int(there[self.level[there].argmax()]) if len(there) else -1

    def descend(self, q: np.ndarray, to: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each query the node that a greedy walk ends at, above layer `to`."""
        at = np.full(len(q), self.entry)
        best = ((self.x[at] - q) ** 2).sum(1)
        counts[:, 0] += 1
        for level in range(int(self.level[self.entry]), 0, -1):
            on = np.flatnonzero(to < level)
            while len(on):
                near = self.links[level][at[on]]
                d = np.where(near < 0, np.inf, squares(self.x[near], q[on]))
                counts[on, 0] += (near >= 0).sum(1)
                counts[on, 1] += 1
                i = d.argmin(1)
                d = d[np.arange(len(on)), i]
                better = d < best[on]
                at[on[better]], best[on[better]] = near[better, i[better]], d[better]
                on = on[better]
        return at

    def _near(self, level: int, nodes: np.ndarray, ok: np.ndarray | None) -> np.ndarray:
        """Nodes (rows by n, -1 for none) that links lead to from each row's nodes; with `ok` allowed ones, within one link or over one that is not allowed."""
        first = np.where(nodes[:, :, None] < 0, -1, self.links[level][nodes])
        first = first.reshape(len(nodes), -1)
        if ok is None:
            return first
        second = np.where(((first < 0) | ok[first])[:, :, None], -1, self.links[level][first]).reshape(len(nodes), -1)
        both = np.concatenate([first, second], 1)
        return np.where((both >= 0) & ok[both], both, -1)

    def walk(self, q: np.ndarray, starts: np.ndarray, level: int, ef: int, counts: np.ndarray, ok: np.ndarray | None = None, over: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes): the ef nearest (allowed) nodes that each query's best-first walk meets; infinite and -1 where there are fewer.

        A walk ends when its nearest open node is farther than all of ef found ones.  With
        `ok` other nodes are walked through, or with `over` links lead over them and their
        distance is never taken; such a walk starts anew from an allowed node that it has
        not seen where it would end with fewer than ef.
        """
        many, n, row = len(q), len(self.x), np.arange(len(q))
        width = ef if ok is None or over else min(n, max(1024, 4 * ef))
        seen = np.zeros((many, n), bool)
        open_d, open_n, done = np.full((many, width), np.inf), np.full((many, width), -1), np.zeros((many, width), bool)
        best_d, best_n = np.full((many, ef), np.inf), np.full((many, ef), -1)
        by = ok if over else None

        def offer(on: np.ndarray, nodes: np.ndarray) -> None:
            nodes = np.sort(nodes, 1)
            fresh = (nodes >= 0) & ~seen[on[:, None], nodes]
            fresh[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
            full = int(fresh.sum(1).max(initial=0))
            if not full:
                return
            order = np.argsort(~fresh, 1, kind="stable")[:, :full]  # what is new comes first
            nodes, fresh = np.take_along_axis(nodes, order, 1), np.take_along_axis(fresh, order, 1)
            d = np.where(fresh, squares(self.x[nodes], q[on]), np.inf)
            counts[on, 0] += fresh.sum(1)
            r, c = np.nonzero(fresh)
            seen[on[r], nodes[r, c]] = True
            good = fresh & (d < best_d[on, -1:])
            for dist, name, flag, mask in ((open_d, open_n, done, good), (best_d, best_n, None, good if ok is None else good & ok[nodes])):
                both = np.concatenate([dist[on], np.where(mask, d, np.inf)], 1)
                names = np.concatenate([name[on], np.where(mask, nodes, -1)], 1)
                order = np.lexsort((names, both))[:, : dist.shape[1]]
                dist[on], name[on] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
                if flag is not None:
                    flag[on] = np.take_along_axis(np.concatenate([flag[on], np.zeros(d.shape, bool)], 1), order, 1)

        if over:
            offer(row, np.concatenate([np.where(ok[starts], starts, -1), self._near(level, starts, ok)], 1))
        else:
            offer(row, starts)
        on = row
        while len(on):
            waiting = ~done[on] & np.isfinite(open_d[on])
            first = waiting.argmax(1)
            go = waiting[np.arange(len(on)), first] & (open_d[on, first] <= best_d[on, -1])
            if over and not go.all():  # a new start for walks that lack some
                lack = on[~go & ~np.isfinite(best_d[on, -1])]
                fresh = ok[None] & ~seen[lack]
                lack, fresh = lack[fresh.any(1)], fresh[fresh.any(1)]
                if len(lack):
                    offer(lack, fresh.argmax(1)[:, None])
                    on = np.concatenate([on[go], lack])
                    continue
            on, waiting = on[go], waiting[go]
            if not len(on):
                break
            rank = np.cumsum(waiting, 1)
            picked = np.argsort(~(waiting & (rank <= FOLLOWED)), 1, kind="stable")[:, :FOLLOWED]
            nodes = np.take_along_axis(open_n[on], picked, 1)
            real = np.take_along_axis(waiting, picked, 1) & (np.take_along_axis(open_d[on], picked, 1) <= best_d[on, -1:])
            nodes = np.where(real, nodes, -1)
            r, c = np.nonzero(real)
            done[on[r], picked[r, c]] = True
            counts[on, 1] += real.sum(1)
            offer(on, self._near(level, nodes, by))
        return best_d, best_n

    def _step(self, ok: np.ndarray | None, over: bool) -> int:
        """Queries whose walks may go on in step."""
        wide = FOLLOWED * 2 * self.m * (1 + 2 * self.m if over else 1) * self.x.shape[1]
        return max(1, min(HELD // max(1, wide), (1 << 27) // max(1, len(self.x))))

    def search(self, q: np.ndarray, ef: int, k: int, ok: np.ndarray | None = None, two_hop: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distances, nodes, counts) of the k nearest (allowed) nodes met by each query; counts are distances and hops."""
        counts = np.zeros((len(q), 2), np.int64)
        d, nodes = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        if self.entry < 0 or ok is not None and not ok.any():
            return d, nodes, counts
        over, ef = two_hop and ok is not None, max(ef, k)
        step = self._step(ok, over)
        for a in range(0, len(q), step):
            own = counts[a : a + step]
            starts = self.descend(q[a : a + step], np.zeros(len(own), np.int64), own)
            found, names = self.walk(q[a : a + step], starts[:, None], 0, ef, own, ok, over)
            d[a : a + step], nodes[a : a + step] = found[:, :k], names[:, :k]
        return d, nodes, counts

    def add(self, nodes: np.ndarray) -> None:
        """Link nodes into every layer up to their own, some at a time: these search the graph as it stands, and one another."""
        at = 0
        while at < len(nodes):
            size = min(ADDED, max(1, int(self.inside.sum())), self._step(None, False))
            self._add(np.asarray(nodes[at : at + size]))
            at += size

    def _add(self, new: np.ndarray) -> None:
        q, counts = self.x[new], np.zeros((len(new), 2), np.int64)
        starts = self.descend(q, self.level[new], counts)[:, None] if self.entry >= 0 else np.full((len(new), 1), -1)
        top = int(self.level[self.entry]) if self.entry >= 0 else -1
        for level in range(int(self.level[new].max()), -1, -1):
            on = np.flatnonzero(self.level[new] >= level)
            if level <= top:
                d, found = self.walk(q[on], starts[on], level, self.ef, counts[on])
                starts = np.concatenate([starts, np.full((len(new), max(0, self.ef - starts.shape[1])), -1)], 1)
                starts[on] = -1
                starts[on, : self.ef] = found
            else:
                d, found = np.full((len(on), 0), np.inf), np.full((len(on), 0), -1)
            own = squares(np.repeat(q[on][None], len(on), 0), q[on])
            np.fill_diagonal(own, np.inf)
            d, found = np.concatenate([d, own], 1), np.concatenate([found, np.where(np.isfinite(own), new[on][None], -1)], 1)
            near = np.argsort(d, 1, kind="stable")[:, : self.ef]
            kept = prune_many(self.x, np.take_along_axis(found, near, 1), np.take_along_axis(d, near, 1), self.m, self.alpha)
            self.links[level][new[on], : self.m] = kept
            r, c = np.nonzero(kept >= 0)
            self._back(level, kept[r, c], new[on][r])
        self.place(new)

    def _back(self, level: int, at: np.ndarray, node: np.ndarray) -> None:
        """Links back from `at` to `node`; a node with too many chooses its links anew."""
        if not len(at):
            return
        targets, own = np.unique(at, return_inverse=True)
        order = np.argsort(own, kind="stable")
        own, node = own[order], node[order]
        size = np.bincount(own)
        more = np.full((len(targets), int(size.max())), -1)
        more[own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)] = node
        more = np.where((more[:, :, None] == self.links[level][targets][:, None]).any(2), -1, more)  # there already
        self._choose(level, targets, np.concatenate([self.links[level][targets], more], 1))

    def _choose(self, level: int, nodes: np.ndarray, found: np.ndarray) -> None:
        """Give nodes the links in `found` (rows with -1 for none): all of them where they have room, else diverse ones."""
        most = self._most(level)
        order = np.argsort(found < 0, 1, kind="stable")
        found = np.take_along_axis(found, order, 1)
        many = (found >= 0).sum(1) > most
        out = np.full((len(nodes), most), -1)
        out[:, : found.shape[1]] = found[:, :most]
        if many.any():
            d = squares(self.x[found[many]], self.x[nodes[many]])
            out[many] = prune_many(self.x, found[many], d, most, self.alpha)
        self.links[level][nodes] = out

    def drop(self, nodes: np.ndarray) -> None:
        """Take nodes out: their neighbours inherit their other neighbours and choose anew where that is too many."""
        gone = np.zeros(len(self.x), bool)
        gone[nodes] = True
        for level, links in enumerate(self.links):
            lost = np.flatnonzero(((links >= 0) & gone[links]).any(1) & ~gone)
            step = max(1, HELD // (links.shape[1] * (1 + links.shape[1]) * self.x.shape[1]))  # their candidates' vectors are held
            for a in range(0, len(lost), step):
                own = lost[a : a + step]
                first = links[own]
                second = np.where(((first < 0) | ~gone[first])[:, :, None], -1, links[first]).reshape(len(own), -1)
                both = np.sort(np.concatenate([first, second], 1), 1)
                bad = (both < 0) | gone[both] | (both == own[:, None])
                bad[:, 1:] |= both[:, 1:] == both[:, :-1]
                self._choose(level, own, np.where(bad, -1, both))
            links[gone] = -1
        self.inside[gone] = False
        self._enter()

    def rows(self, part: int, ids: np.ndarray) -> pd.DataFrame:
        out = []
        for level, links in enumerate(self.links):
            src, at = np.nonzero(links >= 0)
            dst = links[src, at]
            d = ((self.x[dst] - self.x[src]) ** 2).sum(1)
            order = np.lexsort((dst, d, src))
            src, dst, d = src[order], dst[order], d[order]
            pos = np.arange(len(src)) - np.searchsorted(src, src)
            out.append(pd.DataFrame({"part": np.int32(part), "level": np.int32(level), "src": ids[src].astype("int64"), "pos": pos.astype("int32"), "dst": ids[dst].astype("int64"), "dist": d}))
        return pd.concat(out).astype({"part": "int32", "level": "int32"}) if out else pd.DataFrame({c: [] for c in ("part", "level", "src", "pos", "dst", "dist")})


def _nodes(rows: DataFrame, edges: DataFrame | None, m: int) -> DataFrame:
    """(part, vec_id, e, level, allowed, gone, link_level, link_dst): rows with their links as two lists of numbers."""
    own = rows.columns
    rows = rows.withColumn("level", random_level(m=m))
    for name, value in (("allowed", True), ("gone", False), ("new", False)):
        rows = rows if name in own else rows.withColumn(name, F.lit(value))
    rows = rows.select("part", "vec_id", "e", "level", "allowed", "gone", "new")
    if edges is None:
        return _dealt(rows.withColumns({"link_level": F.lit(None).cast("array<int>"), "link_dst": F.lit(None).cast("array<bigint>")}))
    out = edges.groupBy("part", F.col("src").alias("vec_id")).agg(F.collect_list(F.struct("level", "pos", "dst")).alias("links"))
    out = out.withColumn("links", F.array_sort("links")).select("part", "vec_id", F.col("links.level").alias("link_level"), F.col("links.dst").alias("link_dst"))
    return _dealt(rows.join(out, ["part", "vec_id"], "left"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Partitions of the table over as many tasks as the session has: their rows are few and their graphs are work, so they are not to be gathered by bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")


#: Rows of a partition at most: its vectors, links and walks are one task's memory.
MOST_ROWS = 1 << 20


def _loaded(pdf: pd.DataFrame, m: int, ef: int, alpha: float) -> tuple[Graph, np.ndarray, pd.DataFrame]:
    if len(pdf) > MOST_ROWS:
        raise ValueError(f"a graph has at most {MOST_ROWS} rows: deal them into more partitions (`routed`, `partitioned`)")
    pdf = pdf.sort_values("vec_id").drop_duplicates("vec_id")
    ids = pdf["vec_id"].to_numpy()
    graph = Graph(np.stack(pdf["e"].to_numpy()), pdf["level"].to_numpy(), m, ef, alpha)
    graph.place(np.flatnonzero(~pdf["new"].to_numpy(bool)))
    for n, (level, dst) in enumerate(zip(pdf["link_level"], pdf["link_dst"])):
        if dst is None or not len(dst):
            continue
        level, dst = np.asarray(level), np.asarray(dst)
        at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        known = ids[at] == dst
        for k in np.unique(level[known]):
            to = at[known & (level == k)]
            graph.links[k][n, : len(to)] = to
    return graph, ids, pdf


def build(rows: DataFrame, m: int = M, ef: int = EF, alpha: float = 1.0) -> DataFrame:
    """Edges of each partition's graph over its rows (part, vec_id, e), added in order of id."""
    return insert(rows.limit(0), None, rows, m, ef, alpha)


def insert(rows: DataFrame, edges: DataFrame | None, more: DataFrame, m: int = M, ef: int = EF, alpha: float = 1.0) -> DataFrame:
    """Edges after `more` (part, vec_id, e) has been added to the graphs of rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, ids, pdf = _loaded(pdf, m, ef, alpha)
        graph.add(np.flatnonzero(pdf["new"].to_numpy(bool)))
        return graph.rows(int(pdf["part"].iloc[0]), ids)

    own = ("part", "vec_id", "e")
    both = more.select(*own).withColumn("new", F.lit(True)) if edges is None else rows.select(*own).withColumn("new", F.lit(False)).unionByName(more.select(*own).withColumn("new", F.lit(True)))
    return _nodes(both, edges, m).groupBy("part").applyInPandas(run, EDGES)


def delete(rows: DataFrame, edges: DataFrame, gone: DataFrame, m: int = M, alpha: float = 1.0) -> DataFrame:
    """Edges without the ids of `gone`; neighbours inherit what the deleted nodes led to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, ids, pdf = _loaded(pdf, m, EF, alpha)
        graph.drop(np.flatnonzero(pdf["gone"].to_numpy(bool)))
        return graph.rows(int(pdf["part"].iloc[0]), ids)

    marked = rows.select("part", "vec_id", "e").join(gone.select("vec_id").distinct().withColumn("gone", F.lit(True)), "vec_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return _nodes(marked, edges, m).groupBy("part").applyInPandas(run, EDGES)


def walks(queries: DataFrame, rows: DataFrame, edges: DataFrame, k: int, ef: int = EF, m: int = M, probed: DataFrame | None = None, two_hop: bool = False) -> DataFrame:
    """(part, query_id, vec_id, dist, n_distances, n_hops): what each partition's graph gives, and what each walk has cost.

    All partitions are asked, or those that `probed` has as (query_id, part).  Rows may
    carry `allowed`: by default others are walked through and not returned (a deleted row
    that keeps its edges is such a tombstone); with `two_hop` links lead over them.
    """
    masked = "allowed" in rows.columns
    graph = _nodes(rows, edges, m)

    def found(left: pd.DataFrame, asked: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        g, ids, pdf = _loaded(left, m, ef, 1.0)
        d, nodes, counts = g.search(q, ef, k, pdf["allowed"].to_numpy(bool) if masked else None, two_hop)
        row, at = np.nonzero(nodes >= 0)
        columns = {"part": np.full(len(row), pdf["part"].iloc[0], np.int32), "query_id": asked[row], "vec_id": ids[nodes[row, at]], "dist": d[row, at], "n_distances": counts[row, 0], "n_hops": counts[row, 1]}
        return pd.DataFrame(columns)

    small = dense.few(queries.select(F.col("query_id").cast("long").alias("query_id"), "qe"), "query_id", "qe") if probed is None else None
    if small is not None:  # the queries travel to the graphs
        shared = rows.sparkSession.sparkContext.broadcast(small)
        return graph.groupBy("part").applyInPandas(lambda left: found(left, shared.value.ids, shared.value.x), WALKED)
    if probed is None:
        asked = paired(queries.select("query_id", "qe"), rows.select(F.col("part").alias("in_part")).distinct())
    else:
        asked = queries.select("query_id", "qe").join(probed.select("query_id", F.col("part").alias("in_part")), "query_id")
    empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="float64" if c.endswith("double") else "int64") for c in WALKED.split(", ")}).astype({"part": "int32"})
    both = lambda left, right: found(left, right["query_id"].to_numpy(), np.stack(right["qe"].to_numpy()).astype(np.float64)) if len(left) and len(right) else empty
    return graph.groupBy("part").cogroup(asked.groupBy("in_part")).applyInPandas(both, WALKED)


def search(queries: DataFrame, rows: DataFrame, edges: DataFrame, k: int, ef: int = EF, m: int = M, probed: DataFrame | None = None, two_hop: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k nearest that the graphs give, merged."""
    return top_k(walks(queries, rows, edges, k, ef, m, probed, two_hop), k).select("query_id", "rank", "vec_id", "dist")


def costs(walked: DataFrame) -> DataFrame:
    """(query_id, n_parts, n_distances, n_hops) over all partitions of each query."""
    each = walked.groupBy("query_id", "part").agg(F.max("n_distances").alias("n_distances"), F.max("n_hops").alias("n_hops"))
    return each.groupBy("query_id").agg(F.count("*").alias("n_parts"), F.sum("n_distances").alias("n_distances"), F.sum("n_hops").alias("n_hops"))


def expand(frontier: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """(vec_id): nodes that an edge (src, dst) of the frontier leads to and that are in neither it nor `visited`; one step of a walk as joins."""
    met = edges.join(frontier.select(F.col("vec_id").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("vec_id")).distinct()
    return met.join(visited.select("vec_id").unionByName(frontier.select("vec_id")), "vec_id", "left_anti")


def within_cutoff(probed: DataFrame, threshold: float) -> DataFrame:
    """Probes (query_id, part, probe_dist) that are at most `threshold` farther than the query's nearest one."""
    least = probed.groupBy("query_id").agg(F.min("probe_dist").alias("d0"))
    return probed.join(least, "query_id").where(F.col("probe_dist") - F.col("d0") <= threshold).drop("d0")


def routes(queries: DataFrame, cells: DataFrame, n: int, threshold: float | None = None) -> DataFrame:
    """(query_id, part, probe_dist): the n nearest coarse cells of each query, up to a distance cut-off."""
    probed = probes(queries, cells, n).select("query_id", F.col("cid").cast("int").alias("part"), "probe_dist")
    return probed if threshold is None else within_cutoff(probed, threshold)


def prune_edges(edges: DataFrame, rows: DataFrame, most: int, alpha: float = 1.0) -> DataFrame:
    """(src, pos, dst, dist): each node's edges (src, dst, dist) thinned for diversity; a task holds one node's edges at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "dst"])
        x = np.stack(pdf["e"].to_numpy())
        kept = prune(pdf["dist"].to_numpy(), ((x[:, None] - x[None]) ** 2).sum(-1), most, alpha)
        out = pdf.iloc[kept][["src", "dst", "dist"]]
        out.insert(1, "pos", np.arange(len(out), dtype=np.int32))
        return out

    full = edges.select("src", "dst", "dist").join(rows.select(F.col("vec_id").alias("dst"), "e"), "dst")
    return full.groupBy("src").applyInPandas(run, "src long, pos int, dst long, dist double")


def degrees(edges: DataFrame, level: int = 0) -> DataFrame:
    out = edges.where(F.col("level") == level).groupBy("src").agg(F.count("*").alias("n"))
    return out.agg(F.min("n").alias("min_degree"), F.max("n").alias("max_degree"), F.round(F.avg("n"), 6).alias("avg_degree"))
