"""Exact top-k by inner product with no random access.

Every component is a list: a block's vectors sorted by that component, read from the top
for a query whose weight is positive and from the bottom where it is negative.  All
lists are read to the same depth; after each round half of what is unread is read, so
steps get finer towards the end.  What has been read gives each vector a lower bound
(unread components at the list's far end) and an upper bound (unread components at the
last value read).  The k-th best lower bound, or the k-th best score of the blocks before
if that is higher, is the floor: a vector whose upper bound stays below it is an outsider.
A query stops once few enough can still qualify, and only their scores are resolved.

Candidates are dealt into lanes of bounded bytes; a lane is a unit of work that sorts its
lists once, block by block, and holds them while all queries travel by, a block at a time.
It returns k rows a query and how deep it has read; a last window takes the k best.
Bounds are doubles with room for rounding; scores are exact integers (sums outside 64 bits
saturate).

Vectors that are null, or hold null or non-finite components, and rows without an id take
no part.  Missing components of shorter vectors count as zero.  Equal scores go to the
smaller id.  Rows that repeat an id are candidates each by itself; a query finds no row
with its own id, and of rows that repeat a query's id one (with the smallest bytes) asks.
A table without rows or without queries gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_stage, gathered, partitions, stage_table

#: Rows of a block of candidates and of a block of queries, and bytes of a lane of candidates.
CANDIDATES, QUERIES, LANE_BYTES = 4096, 1024, 32 << 20
#: Share of the lists that the first round reads.
FIRST = 1 / 2
PARTIAL = "query_id long, vec_id long, score long, read long, size long"


def _integers(batches, scale: float):
    for batch in batches:
        rows = batch.column("embedding")
        ids, there = batch.column("vec_id"), np.asarray(rows.is_valid())
        offsets = rows.offsets.to_numpy()
        values = rows.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        with np.errstate(over="ignore"):
            values = np.floor(values * scale)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        keep = np.flatnonzero(there & np.asarray(ids.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]]))
        made = [values[offsets[i] : offsets[i + 1]].astype("<f8").tobytes() for i in keep]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(made, pa.binary())], names=["vec_id", "vector"])


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    if width and all(len(r) == 8 * width for r in raw):
        return np.frombuffer(b"".join(raw), "<f8").reshape(-1, width)
    out = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        out[i, : len(r) // 8] = np.frombuffer(r, "<f8")
    return out


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows x with one vector q, exact; sums outside 64 bits saturate."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if bound < 1 << 53:
        return (x @ q).astype(np.int64)
    if bound < 1 << 62:
        return x.astype(np.int64) @ q.astype(np.int64)
    weights = [int(v) for v in q]
    sums = [sum(int(v) * w for v, w in zip(row, weights)) for row in x]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


class SortedLists:
    """One block's lists, and the bounds after reading them to a depth."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, n = ids, x, len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, 0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], 0)

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) scores, queries by vectors; up and down are the positive and negative weights."""
        n, x = len(self.x), self.x
        both = np.concatenate([up, down], 1)
        read = np.concatenate([self.place >= n - depth, self.place < depth], 1)
        twice = np.concatenate([x, x], 1)
        last = np.concatenate([self.sorted[n - depth], self.sorted[depth - 1]])
        far = np.concatenate([self.sorted[0], self.sorted[-1]])
        return both @ np.where(read, twice, far).T, both @ np.where(read, twice, last).T


class Search:
    """The k best of each query of a block, over one block of candidates after another."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        self.query_ids, self.q, self.k = query_ids, q, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]  # (scores, ids), best first
        self.floor = np.full(len(q), -np.inf)
        self.read, self.size = np.zeros(len(q), np.int64), 0  # entries of each list read, and there

    def _resolve(self, query: int, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> None:
        """Exact scores of the vectors that may qualify, merged with the best so far."""
        at = at[ids[at] != self.query_ids[query]]
        scores = np.concatenate([self.best[query][0], exact_scores(x[at], self.q[query])])
        names = np.concatenate([self.best[query][1], ids[at]])
        order = np.lexsort((names, ~scores))[: self.k]
        self.best[query] = scores[order], names[order]
        if len(order) == self.k:
            self.floor[query] = float(scores[order[-1]])

    def add(self, lists: SortedLists) -> None:
        """Read a block's lists round by round, until each query has few left that can qualify."""
        ids, x = lists.ids, lists.x
        n, k, width = len(ids), self.k, x.shape[1]
        self.size += n
        scale = float(np.abs(x).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * max(1, width)
        room = 0.0 if scale < 1 << 53 else scale * width * 2.0**-50  # what rounding may do to a bound
        up, down = np.maximum(self.q, 0), np.minimum(self.q, 0)
        todo, depth = np.arange(len(self.q)), max(1, int(n * FIRST))
        if not np.isfinite(4 * scale * width):  # no bound can be told
            depth = n
        while len(todo) and depth < n:
            lower, upper = lists.bounds(up[todo], down[todo], depth)
            own = ids[None] == self.query_ids[todo][:, None]
            lower[own] = upper[own] = -np.inf
            floor = self.floor[todo]
            if n > k:
                floor = np.maximum(floor, np.partition(lower, n - k, axis=1)[:, n - k])
            open_ = upper >= (floor - 2 * room)[:, None]  # those that tie with the k-th stay open, for the smaller id
            few = open_.sum(1) <= max(4 * k, n // 32)
            for r in np.flatnonzero(few):
                self._resolve(todo[r], ids, x, np.flatnonzero(open_[r]))
            self.read[todo[few]] += depth
            todo, depth = todo[~few], n - (n - depth) // 2
        self.read[todo] += n
        for query in todo:  # read to the ends
            self._resolve(query, ids, x, np.arange(n))

    def rows(self) -> pa.RecordBatch:
        """The best of each query; its first row says how many entries of each list were read, and how many there are."""
        sizes = np.array([len(s) for s, _ in self.best], np.int64)
        first = np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]
        read, size = np.zeros(sizes.sum(), np.int64), np.zeros(sizes.sum(), np.int64)
        read[first], size[first] = self.read[sizes > 0], self.size
        columns = [np.repeat(self.query_ids, sizes), *(np.concatenate([*(b[i] for b in self.best), np.zeros(0, np.int64)]) for i in (1, 0)), read, size]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "read", "size"])


def _lanes(batches, k: int, width: int, most: int):
    """Rows come sorted by lane, the candidates (role 0) first, then the queries."""
    lane, held, asked, lists = None, [], [], []

    def side(rows):
        return np.array([i for i, _ in rows], np.int64), _matrix([v for _, v in rows], width)

    def sorted_():
        if held:
            lists.append(SortedLists(*side(held)))
            held.clear()

    def answered():
        if asked and lists:
            search = Search(*side(asked), k)
            for block in lists:
                search.add(block)
            yield search.rows()
        asked.clear()

    for batch in batches:
        for own, role, i, v in zip(*(batch.column(c).to_pylist() for c in ("lane", "role", "vec_id", "vector"))):
            if own != lane:
                yield from answered()
                lane, lists = own, []
                held.clear()
            if role == 0:
                held.append((i, v))
                if len(held) >= most:
                    sorted_()
                continue
            sorted_()
            asked.append((i, v))
            if len(asked) >= QUERIES:
                yield from answered()
    yield from answered()


def top_k(vectors: DataFrame, queries: str, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score, depth): for each row for which the SQL predicate `queries` on vec_id holds, its k best others.

    `depth` is the share of the lists that the query's walk has read, over all blocks.
    """
    named = gathered(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")))
    parts = partitions(named)
    made = arrow_stage(named, lambda b: _integers(b, scale), "vec_id long, vector binary")
    rows = stage_table(made.withColumn("place", F.monotonically_increasing_id()), "integers")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("vector")), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.octet_length("vector")), F.lit(0)).alias("widest")).first()
    lanes = max(1, -(-counts.bytes // LANE_BYTES), min(-(-counts.n // block), parts))
    candidates = rows.select(F.pmod(F.xxhash64("place"), F.lit(lanes)).cast("int").alias("lane"), F.lit(0).alias("role"), "vec_id", "vector")
    asking = rows.where(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(1).alias("role"), "vec_id", "vector")
    units = candidates.unionByName(asked).repartition(max(parts, lanes), "lane").sortWithinPartitions("lane", "role", "vec_id")
    found = arrow_stage(units, lambda b: _lanes(b, k, counts.widest // 8, block), PARTIAL)
    own = Window.partitionBy("query_id")
    found = found.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).withColumn("depth", F.sum("read").over(own) / F.sum("size").over(own))
    return gathered(found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth"), named)
