"""Dense vectors in Arrow batches: a large table against a small one, by matrix products.

The small side (queries or centroids) is read once, its size is checked against
BROADCAST_BYTES, and it travels as one broadcast.  The large side stays where it is read:
no pair of rows is a row of a DataFrame, and nothing of it is shuffled but each task's k
best for each query.  A small side beyond the budget is None here; callers have another way.

Products only propose: whatever could be among the nearest within rounding is computed
again, difference by difference, before it is ordered.  Ties go to the smaller id.  Rows
without an id, without a vector, of another dimension, or with components that are null
or not finite have no distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

#: Bytes of vectors that may travel to every task.
BROADCAST_BYTES = 64 << 20
#: Distances that are held at a time, some four times over: what a task holds does not grow with the cells.
CELLS = 1 << 19


def size_of(df: DataFrame, *vectors: str) -> int:
    """Bytes of a table: Spark's bound if that is small enough, else measured from its rows and arrays."""
    bound = _bound(df)
    if bound <= BROADCAST_BYTES:
        return bound
    nested = {c for c in vectors if df.schema[c].dataType.elementType.typeName() == "array"}
    sizes = [F.coalesce(F.sum(F.size(F.flatten(c) if c in nested else F.col(c)).cast("long")), F.lit(0)) for c in vectors]
    n, *values = df.agg(F.count("*"), *sizes).first()
    return 8 * (4 + len(df.columns)) * n + 8 * sum(values)


def matrix(column: pa.ListArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows by dimensions, whether a row is usable) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lengths = np.diff(offsets)
    ok = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    if dim is None:
        dim = int(np.bincount(lengths[ok]).argmax()) if ok.any() else 0
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ok &= (lengths == dim) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if ok.all():
        return values[offsets[0] : offsets[-1]].reshape(len(column), dim), ok
    x = np.zeros((len(column), dim))
    x[ok] = values[(offsets[:-1][ok, None] + np.arange(dim))]
    return x, ok


def packed(df: DataFrame, vector: str) -> DataFrame:
    """df with its usable vectors as bytes, for shuffles: `<vector>` of floats where all components of a batch are floats, else of doubles (`wide`); rows without one are left out.

    A list of numbers goes from Spark to Python element by element, bytes go as they are.
    """
    names = [c for c in df.columns if c != vector]

    def run(batches):
        for batch in batches:
            lists = batch.column(vector)
            offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            ok = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False), bool) & (bad[offsets[1:]] == bad[offsets[:-1]])
            kept = values[np.repeat(ok, np.diff(offsets))] if not ok.all() else values[offsets[0] : offsets[-1]]
            with np.errstate(over="ignore"):
                floats = kept.astype(np.float32)
            wide = bool((floats != kept).any())
            data = kept if wide else floats
            ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[ok])]) * data.itemsize
            made = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            own = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), made, pa.array(np.full(len(made), wide))], names=[*names, vector, "wide"])

    return df.select(*names, vector).mapInArrow(run, StructType([*(df.schema[c] for c in names), *StructType.fromDDL(f"{vector} binary, wide boolean").fields]))


def unpacked(table: pa.Table | pa.RecordBatch, vector: str, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As `matrix`, of the columns that `packed` makes."""
    column, wide = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(vector), table.column("wide")))
    if not len(column):
        return np.zeros((0, dim or 0)), np.zeros(0, bool)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, size = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.where(np.asarray(wide), 8, 4)
    lengths = np.diff(offsets) // size
    dim = int(np.bincount(lengths).argmax()) if dim is None else dim
    ok = lengths == dim
    x = np.zeros((len(column), dim))
    for bytes_of, kind in ((4, np.float32), (8, np.float64)):
        on = ok & (size == bytes_of)
        if on.all():
            return data[offsets[0] : offsets[-1]].view(kind).reshape(-1, dim).astype(np.float64), ok
        if on.any():
            x[on] = data[offsets[:-1][on, None] + np.arange(dim * bytes_of)].view(kind)
    return x, ok


@dataclass
class Few:
    """A small table: ids, vectors, and other columns by name."""

    ids: np.ndarray
    x: np.ndarray
    more: dict[str, np.ndarray]


def _bound(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fetched(df: DataFrame, *vectors: str, like: DataFrame | None = None) -> pa.Table | None:
    """A table within the budget, else None.

    Spark's bound decides if it is small enough, or that of `like`, a table of which df has
    at most a row for each row, with vectors as long (of doubles).  What neither bounds is
    computed once, kept while it is measured, and fetched if it fits.
    """
    table = getattr(df, "fetched", None)
    if table is not None:
        return table
    if _bound(df) <= BROADCAST_BYTES or like is not None and 4 * _bound(like) <= BROADCAST_BYTES:
        return df.toArrow()
    kept = df.persist()
    try:
        return kept.toArrow() if size_of(kept, *vectors) <= BROADCAST_BYTES else None
    finally:
        kept.unpersist()


def few(df: DataFrame, id_col: str, vector: str, more: tuple[str, ...] = ()) -> Few | None:
    """The rows with an id and a usable vector, in order of id; None beyond the budget."""
    own = df if hasattr(df, "fetched") else df.select(id_col, vector, *more)
    table = fetched(own, vector)
    if table is None:
        return None
    table = table.filter(table.column(id_col).is_valid())
    x, ok = matrix(table.column(vector))
    ids = table.column(id_col).to_numpy()
    at = np.flatnonzero(ok)
    at = at[np.argsort(ids[at], kind="stable")]
    return Few(ids[at], x[at], {c: table.column(c).to_numpy()[at] for c in more})


def near(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of queries (rows of the result) to vectors, but for rounding."""
    if metric == "l1":
        return np.stack([np.abs(x - one).sum(1) for one in q]) if len(q) else np.zeros((0, len(x)))
    dots = q @ x.T
    if metric == "ip":
        return -dots
    norms = (x * x).sum(1)[None], (q * q).sum(1)[:, None]
    if metric == "l2":
        return norms[0] + norms[1] - 2 * dots
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / (np.sqrt(norms[0]) * np.sqrt(norms[1]))


def total(terms: np.ndarray) -> np.ndarray:
    """Sums over the last axis, added from left to right as SQL and `functions.vectors` add (numpy's own sum adds in pairs, so ties there are none here); the terms are used up."""
    return np.cumsum(terms, -1, out=terms)[..., -1].copy() if terms.shape[-1] else np.zeros(terms.shape[:-1])


def distance(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to one query, or to the rows of as many."""
    if metric == "l2":
        return total((x - q) ** 2)
    if metric == "l1":
        return total(np.abs(x - q))
    dots = total(x * q)
    if metric == "ip":
        return -dots
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / (np.sqrt(total(x * x)) * np.sqrt(total(q * q)))


def slack(x: np.ndarray, q: np.ndarray) -> float:
    """What rounding may do to a distance that `near` gives."""
    return 1e-10 * (1.0 + float((x * x).sum(1).max(initial=0)) + float((q * q).sum(1).max(initial=0)))


#: Queries and rows that are compared at a time, and pairs whose exact distances are held.
TILE, PAIRS = (1024, 2048), 1 << 13


def exactly(metric: str, x: np.ndarray, at: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distances of the rows `at` of x to the rows `row` of q, some pairs at a time."""
    out = np.empty(len(at))
    for a in range(0, len(at), PAIRS):
        out[a : a + PAIRS] = distance(metric, x[at[a : a + PAIRS]], q[row[a : a + PAIRS]])
    return out


class Nearest:
    """The k least distances of each query so far, ties to the smaller id; `limit` bounds what a query takes."""

    def __init__(self, n: int, k: int, limit: np.ndarray | None = None):
        self.k, self.limit = k, np.full(n, np.inf) if limit is None else limit.astype(np.float64)
        self.dist, self.own, self.there = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def least(self, d: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """What no distance in a row of d (but for rounding) has to exceed to be among the k nearest of the row's query."""
        limit = self.limit[queries]
        fresh = np.flatnonzero(np.isinf(limit)) if d.shape[1] > self.k else []
        if len(fresh):
            limit[fresh] = np.nan_to_num(np.partition(d[fresh], self.k - 1, 1)[:, self.k - 1], nan=np.inf, posinf=np.inf)
        return limit

    def offer(self, queries: np.ndarray, row: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Distances and ids for the queries with the numbers queries[row]; row is in order."""
        order = np.lexsort((ids, dist, row))
        order = order[~np.isnan(dist[order])]
        row, dist, ids = row[order], dist[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        on = rank < self.k
        row, dist, ids, rank = row[on], dist[on], ids[on], rank[on]
        if not len(row):
            return
        some, at = np.unique(row, return_inverse=True)
        wide, of = int(rank.max()) + 1, queries[some]
        more = np.full((len(some), wide), np.inf), np.zeros((len(some), wide), np.int64), np.zeros((len(some), wide), bool)
        for to, values in zip(more, (dist, ids, True)):
            to[at, rank] = values
        dist, own, there = (np.concatenate([old[of], new], 1) for old, new in zip((self.dist, self.own, self.there), more))
        order = np.lexsort((own, dist, ~there))[:, : self.k]
        self.dist[of], self.own[of], self.there[of] = (np.take_along_axis(v, order, 1) for v in (dist, own, there))
        full = self.there[of, -1]
        self.limit[of[full]] = np.minimum(self.limit[of[full]], self.dist[of[full], -1])

    def rows(self, ids: np.ndarray, names: tuple[str, str, str] = ("query_id", "vec_id", "dist")) -> pa.RecordBatch:
        row, at = np.nonzero(self.there)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[row], self.own[row, at], self.dist[row, at])], names=list(names))


class Best(Nearest):
    """The k nearest vectors of each query so far, at most `limit` away and with an id within the query's range (low, high) where those are given.

    Tiles of queries and rows are compared by one product each, and what a tile has below
    the limits is ordered for all its queries at once: no query is a turn of a Python loop.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str, limit: np.ndarray | None = None, within: tuple[np.ndarray, np.ndarray] | None = None):
        super().__init__(len(q), k, limit)
        self.q, self.metric, self.within = q, metric, within

    def add(self, ids: np.ndarray, x: np.ndarray, of: np.ndarray | None = None) -> None:
        """Offer vectors to all queries, or to those with the numbers `of`."""
        of = np.arange(len(self.q)) if of is None else of
        for a in range(0, len(ids), TILE[1]):
            part, names = x[a : a + TILE[1]], ids[a : a + TILE[1]]
            for b in range(0, len(of), TILE[0]):
                own = of[b : b + TILE[0]]
                q = self.q[own]
                d, room = near(self.metric, part, q), slack(part, q)
                if self.within is not None:
                    low, high = (v[own][:, None] for v in self.within)
                    d = np.where((names[None] >= low) & (names[None] <= high), d, np.nan)
                row, at = np.nonzero(d <= (self.least(d, own) + room)[:, None])
                if len(row):
                    self.offer(own, row, exactly(self.metric, part, at, q, row), names[at])


FOUND = "query_id long, vec_id long, dist double"


def _usable(batch: pa.RecordBatch, id_col: str, vector: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, ids, vectors) of a batch's usable rows."""
    x, ok = matrix(batch.column(vector), dim)
    ids = batch.column(id_col)
    at = np.flatnonzero(ok & ids.is_valid().to_numpy(zero_copy_only=False).astype(bool))
    return at, ids.take(pa.array(at)).to_numpy(zero_copy_only=False), x[at]


def nearest_rows(queries: Few, base: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, vec_id, dist): each task's k nearest rows (vec_id, e) of each query.

    Queries may have a `limit` (no row beyond it is taken) and a range of ids (low, high).
    """
    shared = base.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q = shared.value
        best = Best(q.x, k, metric, q.more.get("limit"), (q.more["low"], q.more["high"]) if "low" in q.more else None)
        for batch in batches:
            _, ids, x = _usable(batch, "vec_id", "e", q.x.shape[1])
            best.add(ids, x)
        yield best.rows(q.ids)

    return base.select(F.col("vec_id").cast("long").alias("vec_id"), "e").mapInArrow(run, FOUND)


#: Pairs of blocks for each core at least.
PAIRS_A_CORE = 4


def nearest_in_blocks(queries: DataFrame, base: DataFrame, k: int, metric: str, most: int | None = None) -> DataFrame:
    """(query_id, vec_id, dist): as nearest_rows where the queries are more than may travel: both sides are dealt into blocks of at most about `most` bytes, and each pair of blocks is a task's unit.

    The base is shuffled once for each block of queries.  No key holds more than two blocks,
    and there are more keys than cores.  Queries may have a `limit`.
    """
    most = most or BROADCAST_BYTES // 2
    blocks = lambda df, v: max(1, -(-size_of(df, v) // most))
    limited = "limit" in queries.columns
    queries, base = queries.select("query_id", "qe", *["limit"] * limited), base.select(F.col("vec_id").cast("long").alias("vec_id"), "e")
    least = math.isqrt(PAIRS_A_CORE * base.sparkSession.sparkContext.defaultParallelism) + 1
    n, m = max(least, blocks(queries, "qe")), max(least, blocks(base, "e"))
    number = lambda name, of: F.pmod(F.xxhash64(name), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = packed(queries, "qe").withColumn("q", number("query_id", n)).withColumn("b", every(m))
    right = packed(base, "e").withColumn("b", number("vec_id", m)).withColumn("q", every(n))

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, ok = unpacked(asked, "qe")
        ids = asked.column("query_id").to_numpy()
        ok &= np.asarray(asked.column("query_id").is_valid())
        best = Best(q[ok], k, metric, asked.column("limit").to_numpy()[ok] if limited else None)
        for batch in rows.to_batches(max_chunksize=10_000) if ok.any() else ():
            x, there = unpacked(batch, "e", q.shape[1])
            at = np.flatnonzero(there & np.asarray(batch.column("vec_id").is_valid()))
            best.add(batch.column("vec_id").take(pa.array(at)).to_numpy(zero_copy_only=False), x[at])
        return pa.Table.from_batches([best.rows(ids[ok].astype(np.int64))])

    return left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(run, FOUND)


def count_within(queries: Few, base: DataFrame, factor: float, metric: str) -> DataFrame:
    """(query_id, n_within): rows of the base at most d0 + |d0| * (factor - 1) from each query, d0 its smallest distance."""
    least = nearest_rows(queries, base, 1, metric).groupBy("query_id").agg(F.min("dist").alias("d0")).toArrow()  # a row a query
    d0 = dict(zip(least.column("query_id").to_pylist(), least.column("d0").to_pylist()))
    limit = np.array([d0.get(i, -np.inf) for i in queries.ids.tolist()])
    shared = base.sparkSession.sparkContext.broadcast((queries, limit + np.abs(limit) * (factor - 1) if len(limit) else limit))

    def run(batches):
        q, most = shared.value
        counts = np.zeros(len(q.ids), np.int64)
        for batch in batches:
            _, ids, x = _usable(batch, "vec_id", "e", q.x.shape[1])
            step = max(1, CELLS // max(1, len(q.ids)))
            for a in range(0, len(ids), step):
                part = x[a : a + step]
                d, room = near(metric, part, q.x) - most[:, None], slack(part, q.x)
                counts += (d < -room).sum(1)
                query, at = np.nonzero(np.abs(d) <= room)  # too close to tell
                np.add.at(counts, query, distance(metric, part[at], q.x[query]) <= most[query])
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[on]), pa.array(counts[on])], names=["query_id", "n_within"])

    parts = base.select(F.col("vec_id").cast("long").alias("vec_id"), "e").mapInArrow(run, "query_id long, n_within long")
    return parts.groupBy("query_id").agg(F.sum("n_within").alias("n_within"))


def rows_within(queries: Few, base: DataFrame, radius: float, metric: str) -> DataFrame:
    """(query_id, vec_id, dist): all rows (vec_id, e) at most `radius` from each query."""
    shared = base.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q = shared.value
        for batch in batches:
            _, ids, x = _usable(batch, "vec_id", "e", q.x.shape[1])
            step = max(1, CELLS // max(1, len(q.ids)))
            for a in range(0, len(ids), step):
                part = x[a : a + step]
                query, at = np.nonzero(near(metric, part, q.x) <= radius + slack(part, q.x))
                d = distance(metric, part[at], q.x[query])
                on = d <= radius
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[query[on]]), pa.array(ids[a + at[on]]), pa.array(d[on])], names=["query_id", "vec_id", "dist"])

    return base.select(F.col("vec_id").cast("long").alias("vec_id"), "e").mapInArrow(run, FOUND)


def _first(d: np.ndarray, x: np.ndarray, q: np.ndarray, metric: str, extra: np.ndarray | None, k: int, room: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k rows of q with the least cost to each row of x, in order of cost, then place; -1 where there are fewer.

    d: costs, rows of x by rows of q, but for rounding (infinite: no candidate); extra: what a cost has beside the distance.
    """
    n, m = d.shape
    k = min(k, m)
    limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k < m else np.full(n, np.inf)
    row, at = np.nonzero((d <= (limit + 2 * room)[:, None]) & np.isfinite(d))
    dist = exactly(metric, q, at, x, row)
    cost = dist + extra[at] if extra is not None else dist
    order = np.lexsort((at, cost, row))
    row, at, dist = row[order], at[order], dist[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    on = rank < k
    places, dists = np.full((n, k), -1), np.full((n, k), np.nan)
    places[row[on], rank[on]], dists[row[on], rank[on]] = at[on], dist[on]
    return places, dists


def _pieces(n: int, m: int):
    step = min(PAIRS, max(1, CELLS // max(1, m)))
    return [(a, min(a + step, n)) for a in range(0, n, step)]


def _closest(cells: Few, x: np.ndarray, metric: str, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the cell with the least distance plus extra for each row; -1 without any."""
    d = near(metric, cells.x, x)
    d = d + extra if extra is not None else d
    places, dists = _first(d, x, cells.x, metric, extra, 1, slack(x, cells.x))
    return places[:, 0], dists[:, 0]


def with_nearest(rows: DataFrame, cells: Few, kind, metric: str, penalty: np.ndarray | None = None, vector: str = "e") -> DataFrame:
    """The rows with their nearest cell (cid of type `kind`, dist), by distance plus penalty; null where a row has no distance."""
    shared = rows.sparkSession.sparkContext.broadcast((cells, penalty))
    names, at = rows.columns, rows.columns.index(vector)

    def run(batches):
        c, extra = shared.value
        for batch in batches:
            x, ok = matrix(batch.column(at), c.x.shape[1])
            cid, dist = np.zeros(len(x), c.ids.dtype), np.zeros(len(x))
            ok &= len(c.ids) > 0
            for a, b in _pieces(len(x), len(c.ids)) if len(c.ids) else []:
                places, dist[a:b] = _closest(c, x[a:b], metric, extra)
                cid[a:b] = c.ids[places]
                ok[a:b] &= places >= 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid, mask=~ok), pa.array(dist, mask=~ok)], names=[*names, "cid", "dist"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cid", kind), StructField("dist", DoubleType())]))


def with_lists(rows: DataFrame, cells: Few, k: int, metric: str) -> DataFrame:
    """(vec_id, cids, dists): the k nearest cells of each row (vec_id, e) in order, where the row is read; rows without a usable vector go."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        c = shared.value
        for batch in batches:
            x, ok = matrix(batch.column("e"), c.x.shape[1])
            for a, b in _pieces(len(x), len(c.ids)) if len(c.ids) else []:
                places, dists = _first(near(metric, c.x, x[a:b]), x[a:b], c.x, metric, None, k, slack(x[a:b], c.x))
                on = np.flatnonzero(ok[a:b] & (places >= 0).all(1))
                offsets = np.arange(len(on) + 1, dtype=np.int32) * places.shape[1]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[on].ravel())) for v in (c.ids[places].astype(np.int64), dists)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(a + on)), *lists], names=["vec_id", "cids", "dists"])

    return rows.select("vec_id", "e").mapInArrow(run, StructType([rows.schema["vec_id"], *StructType.fromDDL("cids array<long>, dists array<double>").fields]))


def with_bids(lists: DataFrame, prices: dict[int, float]) -> DataFrame:
    """(vec_id, cid, dist, regret) of rows with lists: the cell of least distance plus price, and what the second one would cost more (infinite with one)."""
    names = np.array(sorted(prices), np.int64)
    shared = lists.sparkSession.sparkContext.broadcast((names, np.array([prices[i] for i in names.tolist()])))

    def run(batches):
        ids, price = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            k = len(batch.column("cids")[0])
            cids, dists = (batch.column(c).flatten().to_numpy().reshape(-1, k) for c in ("cids", "dists"))
            cost = dists + price[np.searchsorted(ids, cids)]
            order = np.argsort(cost, 1, kind="stable")
            row, best = np.arange(len(cost)), order[:, 0]
            regret = cost[row, order[:, 1]] - cost[row, best] if k > 1 else np.full(len(cost), np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cids[row, best]), pa.array(dists[row, best]), pa.array(regret)], names=["vec_id", "cid", "dist", "regret"])

    return lists.mapInArrow(run, StructType([lists.schema["vec_id"], *StructType.fromDDL("cid long, dist double, regret double").fields]))


def nearest_in(rows: DataFrame, group: str, minis: Few, kind, metric: str) -> DataFrame:
    """The rows (group, vec_id, e) with the nearest of the minis that belong to their group (mini_id, dist)."""
    shared = rows.sparkSession.sparkContext.broadcast(minis)
    names = rows.columns

    def run(batches):
        low = shared.value
        owner = low.more["mega_id"]
        for batch in batches:
            x, ok = matrix(batch.column("e"), low.x.shape[1])
            ok &= batch.column(group).is_valid().to_numpy(zero_copy_only=False).astype(bool)
            own = batch.column(group).fill_null(-1).to_numpy()
            for a, b in _pieces(len(x), len(low.ids)) if len(low.ids) else []:
                d = np.where(own[a:b, None] == owner[None], near(metric, low.x, x[a:b]), np.inf)
                places, dists = _first(d, x[a:b], low.x, metric, None, 1, slack(x[a:b], low.x))
                at = np.flatnonzero(ok[a:b] & (places[:, 0] >= 0))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(a + at)) for c in batch.columns), pa.array(low.ids[places[at, 0]]), pa.array(dists[at, 0])], names=[*names, "mini_id", "dist"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("mini_id", kind), StructField("dist", DoubleType())]))


def own_and_other(rows: DataFrame, cells: Few, metric: str) -> DataFrame:
    """(vec_id, cid, a, b, other): distance of each row (vec_id, e, cid) to its own cell, and to the nearest other one."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    own = rows.select("vec_id", "cid", "e")

    def run(batches):
        c = shared.value
        for batch in batches:
            x, ok = matrix(batch.column("e"), c.x.shape[1])
            ok &= batch.column("cid").is_valid().to_numpy(zero_copy_only=False).astype(bool)
            names = batch.column("cid").fill_null(-1).to_numpy()
            for lo, hi in _pieces(len(x), len(c.ids)) if len(c.ids) else []:
                part, mine = x[lo:hi], names[lo:hi, None] == c.ids[None]
                d, room = near(metric, c.x, part), slack(part, c.x)
                at = mine.argmax(1)
                a = np.where(mine.any(1), distance(metric, part, c.x[at]), np.nan)
                others = np.where(mine, np.inf, d)
                other, b = _first(others, part, c.x, metric, None, 1, room)
                on = np.flatnonzero(ok[lo:hi])
                picked = batch.take(pa.array(lo + on))
                yield pa.RecordBatch.from_arrays([picked.column("vec_id"), picked.column("cid"), pa.array(a[on], mask=np.isnan(a[on])), pa.array(b[on, 0], mask=np.isnan(b[on, 0])), pa.array(c.ids[other[on, 0]], mask=other[on, 0] < 0)], names=["vec_id", "cid", "a", "b", "other"])

    return own.mapInArrow(run, StructType([*own.schema.fields[:2], StructField("a", DoubleType()), StructField("b", DoubleType()), StructField("other", own.schema["cid"].dataType)]))


def own_distance(rows: DataFrame, cells: Few, key: str, kinds, metric: str) -> DataFrame:
    """(mini_id, mega_id, vec_id, dist): each row (mini_id, vec_id, e) with its distance to its own cell; rows of no cell have none."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    own = rows.select(key, "vec_id", "e")

    def run(batches):
        c = shared.value
        for batch in batches:
            x, ok = matrix(batch.column("e"), c.x.shape[1])
            names = batch.column(key).fill_null(-1).to_numpy()
            at = np.searchsorted(c.ids, names)
            at[at == len(c.ids)] = 0
            ok &= batch.column(key).is_valid().to_numpy(zero_copy_only=False).astype(bool)
            ok &= c.ids[at] == names if len(c.ids) else False
            on = np.flatnonzero(ok)
            picked, at = batch.take(pa.array(on)), at[on]
            yield pa.RecordBatch.from_arrays([picked.column(key), pa.array(c.more["mega_id"][at]), picked.column("vec_id"), pa.array(exactly(metric, c.x, at, x, on))], names=[key, "mega_id", "vec_id", "dist"])

    return own.mapInArrow(run, StructType([own.schema[key], StructField("mega_id", kinds), own.schema["vec_id"], StructField("dist", DoubleType())]))


def placed(spark, table: pa.Table, schema) -> DataFrame:
    """A small Arrow table as a DataFrame that remembers it: `few` and `fetched` need no job for it."""
    out = spark.createDataFrame(table, schema)
    out.fetched = table
    return out


def local(df: DataFrame, vector: str = "c", like: DataFrame | None = None) -> DataFrame:
    """The same rows from the driver where they fit the budget: they are computed once, whatever reads them."""
    table = fetched(df, vector, like=like)
    return placed(df.sparkSession, table, df.schema) if table is not None else df


def means_of_few(df: DataFrame, key: str, vector: str, fixed: int) -> DataFrame | None:
    """(key, c, n) of the rows of a `local` table, in the arithmetic of the means of large ones; None where it isn't local, or sums leave 64 bits."""
    table = getattr(df, "fetched", None)
    if table is None:
        return None
    table = table.filter(table.column(key).is_valid())
    x, ok = matrix(table.column(vector))
    names, own = np.unique(table.column(key).to_numpy()[ok], return_inverse=True)
    x = x[ok]
    if float(np.abs(x).sum(0).max(initial=0)) * fixed >= 1 << 62:
        return None
    sums = np.zeros((len(names), x.shape[1]), np.int64)
    np.add.at(sums, own, np.floor(x * fixed).astype(np.int64))
    n = np.bincount(own, minlength=len(names))
    c = pa.array(list(sums.astype(np.float64) / float(fixed) / n[:, None]), pa.list_(pa.float64()))
    schema = StructType([df.schema[key], StructField("c", ArrayType(DoubleType())), StructField("n", LongType())])
    return placed(df.sparkSession, pa.table({key: pa.array(names), "c": c, "n": pa.array(n)}), schema)


#: Rows that are made at a time.
MADE = 1 << 16


def with_probes(queries: DataFrame, cells: Few, kind, k: int, metric: str, name: str = "cid", carry: bool = True) -> DataFrame:
    """(query_id, qe, cid, probe_dist, probe_rank): the k nearest cells of each query; without `carry` no qe, which would be repeated k times."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        c = shared.value
        for batch in batches:
            q, ok = matrix(batch.column("qe"), c.x.shape[1])
            wide = max(len(c.ids), 8 * min(k, len(c.ids)))  # many probes: fewer queries at a time
            for a, b in _pieces(len(q), wide) if len(c.ids) else []:
                places, dists = _first(near(metric, c.x, q[a:b]), q[a:b], c.x, metric, None, k, slack(q[a:b], c.x))
                places[~ok[a:b]] = -1
                every, ranks = np.nonzero(places >= 0)
                for at in range(0, max(1, len(every)), MADE):
                    row, rank = every[at : at + MADE], ranks[at : at + MADE]
                    picked = batch.take(pa.array(a + row)) if carry else batch.select(["query_id"]).take(pa.array(a + row))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(c.ids[places[row, rank]]), pa.array(dists[row, rank]), pa.array((rank + 1).astype(np.int32))], names=[*picked.schema.names, name, "probe_dist", "probe_rank"])

    own = queries.select("query_id", "qe")
    fields = own.schema.fields if carry else own.schema.fields[:1]
    return own.mapInArrow(run, StructType([*fields, StructField(name, kind), StructField("probe_dist", DoubleType()), StructField("probe_rank", IntegerType())]))


def with_minis(queries: DataFrame, megas: Few, minis: Few, kind, n_megas: int, n_minis: int, metric: str, always: np.ndarray) -> DataFrame:
    """(query_id, qe, mini_id, mega_id): the nearest minis among those of each query's nearest megas and of the megas in `always`."""
    shared = queries.sparkSession.sparkContext.broadcast((megas, minis, always))

    def run(batches):
        top, low, every = shared.value
        owner = low.more["mega_id"]
        probed = np.flatnonzero(~np.isin(top.ids, every))
        base = np.isin(owner, every)
        for batch in batches:
            q, ok = matrix(batch.column("qe"), low.x.shape[1])
            for a, b in _pieces(len(q), len(low.ids) + len(top.ids)) if len(low.ids) else []:
                part = q[a:b]
                allowed = np.repeat(base[None], b - a, 0)
                if len(probed):
                    first, _ = _first(near(metric, top.x[probed], part), part, top.x[probed], metric, None, n_megas, slack(part, top.x))
                    for r in range(first.shape[1]):
                        there = first[:, r] >= 0
                        allowed[there] |= owner[None] == top.ids[probed][first[there, r]][:, None]
                d = np.where(allowed, near(metric, low.x, part), np.inf)
                places, _ = _first(d, part, low.x, metric, None, n_minis, slack(part, low.x))
                places[~ok[a:b]] = -1
                row, rank = np.nonzero(places >= 0)
                picked, at = batch.take(pa.array(a + row)), places[row, rank]
                yield pa.RecordBatch.from_arrays([picked.column("query_id"), picked.column("qe"), pa.array(low.ids[at]), pa.array(owner[at])], names=["query_id", "qe", "mini_id", "mega_id"])

    own = queries.select("query_id", "qe")
    return own.mapInArrow(run, StructType([*own.schema.fields, StructField("mini_id", kind[0]), StructField("mega_id", kind[1])]))


def scan_cells(queries: Few, cell_of: np.ndarray, query_of: np.ndarray, rows: DataFrame, cell: str, k: int, metric: str) -> DataFrame:
    """(query_id, vec_id, dist): each task's k nearest rows (cell, vec_id, e) of each query, of the cells that it probes.

    query_of[i] is the number of a query that probes cell_of[i].  Rows of cells that no query
    probes are filtered where they are read; a table laid out by cell skips them.
    """
    order = np.argsort(cell_of, kind="stable")
    wanted, begins = np.unique(cell_of[order], return_index=True)
    shared = rows.sparkSession.sparkContext.broadcast((queries, wanted, np.append(begins, len(order)), query_of[order]))
    if len(wanted) <= 4096:
        rows = rows.where(F.col(cell).isin(wanted.tolist()))

    def run(batches):
        q, cells, first, asking = shared.value
        best = Best(q.x, k, metric)
        for batch in batches:
            at, ids, x = _usable(batch, "vec_id", "e", q.x.shape[1])
            own = batch.column(cell).take(pa.array(at)).to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            for name, rows_of in zip(*_groups(own[order], order)):
                c = np.searchsorted(cells, name)
                if c < len(cells) and cells[c] == name:
                    best.add(ids[rows_of], x[rows_of], asking[first[c] : first[c + 1]])
        yield best.rows(q.ids)

    return rows.select(cell, F.col("vec_id").cast("long").alias("vec_id"), "e").mapInArrow(run, FOUND)


def _groups(names: np.ndarray, order: np.ndarray):
    at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
    return names[at], np.split(order, at[1:]) if len(at) else []


def summed(sums: dict, key: str, kind) -> pa.RecordBatch:
    """(key, sums, n) of sums by name, whose numbers go into one array and are never Python's own."""
    offsets = np.cumsum([0, *(len(s) for s, _ in sums.values())], dtype=np.int32)
    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s for s, _ in sums.values()])))
    return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), values, pa.array([n for _, n in sums.values()], pa.int64())], names=[key, "sums", "n"])


def group_sums(rows: DataFrame, key: str, vector: str, fixed: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, sums, n): element-wise sums of floor(x * fixed) and sizes by group, one row a group and task (or a few, if a task has many groups)."""
    own = rows.select(key, vector)

    def run(batches):
        sums: dict = {}
        dim = kind = None
        for batch in batches:
            kind = batch.column(0).type
            x, ok = matrix(batch.column(1), dim)
            if not ok.any():
                continue
            dim = x.shape[1]
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            at, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            for a, b in _pieces(len(x), dim):
                on = a + np.flatnonzero(ok[a:b])
                _add(sums, at[on], names, x[on], fixed)
            if len(sums) * dim * 8 > most_bytes:
                yield summed(sums, key, kind)
                sums.clear()
        if sums:
            yield summed(sums, key, kind)

    return own.mapInArrow(run, StructType([own.schema[0], *StructType.fromDDL("sums array<long>, n long").fields]))


def _add(sums: dict, at: np.ndarray, names, x: np.ndarray, fixed: int) -> None:
    """Add rows to the sums and sizes by name: row i belongs to names[at[i]]."""
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
    totals, counts = np.add.reduceat(np.floor(x[order] * fixed).astype(np.int64), begins, axis=0), np.diff(np.append(begins, len(order)))
    for place, total, n in zip(at[order][begins].tolist(), totals, counts.tolist()):
        s, m = sums.get(names[place], (0, 0))
        sums[names[place]] = s + total, m + n


def nearest_sums(rows: DataFrame, cells: Few, key: StructField, metric: str, penalty: np.ndarray | None, fixed: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, sums, n): group_sums of the rows (e) by their nearest cell, in one pass: a task has one Python process for both and no row goes on."""
    shared = rows.sparkSession.sparkContext.broadcast((cells, penalty))
    name = key.name

    def run(batches):
        c, extra = shared.value
        sums: dict = {}
        kind, names, dim = pa.array(c.ids).type, c.ids.tolist(), c.x.shape[1]
        for batch in batches if names else ():
            x, ok = matrix(batch.column(0), dim)
            for a, b in _pieces(len(x), max(dim, len(names))):
                places, _ = _closest(c, x[a:b], metric, extra)
                on = np.flatnonzero(ok[a:b] & (places >= 0))
                _add(sums, places[on], names, x[a + on], fixed)
            if len(sums) * dim * 8 > most_bytes:
                yield summed(sums, name, kind)
                sums.clear()
        if sums:
            yield summed(sums, name, kind)

    return rows.select("e").mapInArrow(run, StructType([key, *StructType.fromDDL("sums array<long>, n long").fields]))


def sides(rows: DataFrame, vector: str) -> DataFrame:
    """(low, high): each task's smallest and largest component of each dimension, a row a task; rows without a usable vector are left out."""

    def run(batches):
        low = high = None
        for batch in batches:
            x, ok = matrix(batch.column(0), None if low is None else len(low))
            if ok.any():
                a, b = x[ok].min(0), x[ok].max(0)
                low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64()))], names=["low", "high"])

    return rows.select(vector).mapInArrow(run, "low array<double>, high array<double>")


def packed_codes(rows: DataFrame) -> DataFrame:
    """(vec_id, codes, tight) of rows with 2-bit codes and a mask of their groups: four codes a byte, the first in the lowest bits, and eight flags a byte."""

    def run(batches):
        for batch in batches:
            codes, masks = batch.column("codes"), batch.column("mask")
            made: tuple[list, list] = ([], [])
            for i in range(batch.num_rows):
                own, flags = codes[i].as_py() or [], masks[i].as_py() or []  # none: of another number of bytes than any query
                four = np.zeros(-(-len(own) // 4) * 4, np.uint8)
                four[: len(own)] = own
                made[0].append((four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes())
                made[1].append(np.packbits(np.array(flags, bool), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(v, pa.binary()) for v in made)], names=["vec_id", "codes", "tight"])

    return rows.select("vec_id", "codes", "mask").mapInArrow(run, "vec_id long, codes binary, tight binary")


#: Bytes of look-up tables that are held at a time.
TABLES = 8 << 20


def looked_up(best: Nearest, queries: np.ndarray, table: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
    """Offer rows to queries: a row's distance is the sum, in order, of the places at[row] of the query's table."""
    step = max(1, TABLES // (8 * len(queries)))
    for a in range(0, len(ids), step):
        part = at[a : a + step]
        d = table[:, part[:, 0]]
        for place in part.T[1:]:
            d += table[:, place]
        row, found = np.nonzero(d <= best.least(d, queries)[:, None])
        best.offer(queries, row, d[row, found], ids[a : a + step][found])


def nearest_coded(queries: Few, tables: np.ndarray, coded: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, dist): each task's k nearest rows (vec_id, codes) of each query by sums of looked-up distances.

    tables: queries by slices by codes; rows of another number of slices, or with a code that is not there, are left out.
    """
    _, slices, size = tables.shape
    shared = coded.sparkSession.sparkContext.broadcast((queries.ids, tables.reshape(len(tables), -1)))

    def run(batches):
        names, table = shared.value
        best = Nearest(len(names), k)
        for batch in batches:
            codes, ok = matrix(batch.column("codes"), slices)
            ok &= ((codes >= 0) & (codes < size)).all(1)
            on = np.flatnonzero(ok)
            ids = batch.column("vec_id").take(pa.array(on)).to_numpy(zero_copy_only=False)
            at = np.arange(slices) * size + codes[on].astype(np.int64)
            for a in range(0, len(names) if len(on) else 0, TILE[0]):
                own = np.arange(a, min(a + TILE[0], len(names)))
                looked_up(best, own, table[a : a + TILE[0]], ids, at)
        yield best.rows(names)

    return coded.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "codes").mapInArrow(run, FOUND)


def nearest_packed(queries: Few, packed: DataFrame, params: dict[str, np.ndarray], k: int) -> DataFrame:
    """(query_id, vec_id, dist): each task's k nearest rows (vec_id, codes, tight) of each query by squared L2 to what codes decode to.

    A query has a table of 256 sums for each byte and range, so a row costs a look-up and
    an addition for each four dimensions; codes are not unpacked.
    """
    dim = queries.x.shape[1]
    groups = -(-dim // 4)
    shared = packed.sparkSession.sparkContext.broadcast((queries, params))

    def tables(q: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
        digit = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3  # 256 bytes by four codes
        out = np.zeros((len(q), groups, 2, 256))
        for tight, (low, width) in enumerate((("low", "width"), ("tight_low", "tight_width"))):
            for j in range(dim):
                value = digit[:, j % 4] * (p[width][j] / 4) + (p[width][j] / 8 + p[low][j])
                out[:, j // 4, tight] += (q[:, j, None] - value[None]) ** 2
        return out.reshape(len(q), -1)

    def run(batches):
        asked, p = shared.value
        best, held, n = Nearest(len(asked.ids), k), [], 0

        def compare():
            """All queries with the rows held, some tables at a time: these are 64 kB a query for 64 dimensions."""
            ids, at = (np.concatenate(v) for v in zip(*held))
            step = max(1, TABLES // (groups * 512 * 8))
            for a in range(0, len(asked.ids), step):
                table, own = tables(asked.x[a : a + step], p), np.arange(a, min(a + step, len(asked.ids)))
                looked_up(best, own, table, ids, at)

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            lengths = np.array([len(v) for v in batch.column("codes").to_pylist()])
            keep = np.flatnonzero(lengths == groups)
            if not len(keep):
                continue
            own = batch.take(pa.array(keep))
            byte = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(-1, groups)
            flags = np.unpackbits(np.frombuffer(b"".join(own.column("tight").to_pylist()), np.uint8).reshape(len(keep), -1), axis=1, bitorder="little")[:, :groups]
            held.append((ids[keep], (np.arange(groups) * 512 + flags.astype(np.int32) * 256 + byte).astype(np.int32)))
            n += len(keep)
            if n >= MADE:
                compare()
                held, n = [], 0
        if held:
            compare()
        yield best.rows(asked.ids)

    return packed.where(F.col("vec_id").isNotNull()).mapInArrow(run, FOUND)


def merged_sums(parts: DataFrame, key: str, fixed: int) -> DataFrame:
    """(key, c, n): means from group_sums' rows of all tasks; rows come sorted by key, so a task holds one group's sums."""

    def run(batches):
        name, sums, n, started = None, None, 0, False
        done: tuple[list, list, list] = ([], [], [])

        def close():
            if started:
                whole = sums.astype(np.float64) if sums.dtype != object else np.array([float(v) for v in sums])
                for column, value in zip(done, (name, (whole / float(fixed) / n).tolist(), n)):
                    column.append(value)

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1], pa.list_(pa.float64())), pa.array(done[2], pa.int64())], names=[key, "c", "n"])
            for column in done:
                column.clear()
            return made

        for batch in batches:
            kind = batch.column(0).type
            values, counts = batch.column(1), batch.column(2).to_pylist()
            flat, offsets = values.values.to_numpy(), values.offsets.to_numpy()
            for i, own in enumerate(batch.column(0).to_pylist()):
                part = flat[offsets[i] : offsets[i + 1]]
                if not started or own != name:
                    close()
                    name, sums, n, started = own, part.copy(), counts[i], True
                    continue
                if sums.dtype != object and (np.abs(sums.astype(np.float64)) + np.abs(part.astype(np.float64)) >= 1 << 62).any():
                    sums = sums.astype(object)
                sums, n = sums + part, n + counts[i]
            if len(done[0]) >= 1000:
                yield out()
        close()
        if done[0]:
            yield out()

    schema = StructType([parts.schema[0], StructField("c", ArrayType(DoubleType())), StructField("n", LongType())])
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def penalty_of(cells: DataFrame, penalty: Column) -> DataFrame:
    return cells.withColumn("__penalty", penalty.cast("double"))
