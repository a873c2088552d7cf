"""Clusters: means, assignment, k-means with splitting, balance and caps, scores, maintenance.

Means are taken in fixed point (1e-9), so that no order of rows changes them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.vectors import boundary_ratio, distance, normalized, silhouette, uniform
from . import dense
from .search import paired, probes

FIXED = 1_000_000_000


def means(rows: DataFrame, key: str, vector: str = "e") -> DataFrame:
    """(key, c, n): element-wise mean and size of each group; each task sums its own rows first, and one shuffle of the sums follows."""
    return dense.merged_sums(dense.group_sums(rows, key, vector, FIXED), key, FIXED)


def means_above(minis: DataFrame) -> DataFrame:
    """(mega_id, c, n): the mean of the centroids (mega_id, c) of each mega, without a job where those are on the driver already."""
    megas = dense.means_of_few(minis, "mega_id", "c", FIXED)
    return dense.local(means(minis.select("mega_id", F.col("c").alias("e")), "mega_id")) if megas is None else megas


def assign(rows: DataFrame, centroids: DataFrame, metric: str = "l2", penalty: Column | None = None) -> DataFrame:
    """Each row with its nearest centroid (cid, dist); the lowest cid wins ties.  A penalty may use centroid columns.

    The centroids travel and nothing is shuffled; rows that repeat an id are assigned each
    by itself.  A row without a usable vector has a null cid.
    """
    named = dense.penalty_of(centroids, penalty if penalty is not None else F.lit(0.0))
    cells = dense.few(named, "cid", "c", ("__penalty",))
    if cells is not None:
        return dense.with_nearest(rows, cells, centroids.schema["cid"].dataType, metric, cells.more["__penalty"] if penalty is not None else None)
    pairs = paired(rows.select(F.struct(*rows.columns).alias("row"), "e"), named.select("cid", "c", "__penalty")).withColumn("dist", distance(metric, "e", "c"))
    best = pairs.groupBy("row").agg(F.min_by(F.struct("cid", "dist"), F.struct(F.col("dist") + F.col("__penalty"), "cid")).alias("b"), (F.count("*") / F.count_distinct("cid")).cast("int").alias("times"))
    return best.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*", "b.cid", "b.dist")


def means_of_nearest(rows: DataFrame, centroids: DataFrame, metric: str = "l2", penalty: Column | None = None) -> DataFrame:
    """(cid, c, n): `means` of the rows by their nearest centroid, as `assign` finds it.

    Where the centroids travel, one Python pass finds a row's centroid and adds the row up.
    """
    named = dense.penalty_of(centroids, penalty if penalty is not None else F.lit(0.0))
    cells = dense.few(named, "cid", "c", ("__penalty",))
    if cells is None:
        return means(assign(rows, centroids, metric, penalty).where(F.col("cid").isNotNull()), "cid")
    return dense.merged_sums(dense.nearest_sums(rows, cells, centroids.schema["cid"], metric, cells.more["__penalty"] if penalty is not None else None, FIXED), "cid", FIXED)


def num_centroids(n: int, size: int) -> int:
    """Clusters of about `size` for n rows: a rest counts as one more only above 0.6 of a cluster."""
    return max(1, n // size + (n % size > 0.6 * size))


def num_centroids_of(n: Column, size: int) -> Column:
    """num_centroids of a column of numbers."""
    return F.greatest(F.lit(1), F.floor(n / size) + (n % size > 0.6 * size).cast("long")).cast("long")


def centroid_sizes(n: int, k: int, ratio: float = 1.0, least: int = 50_000) -> tuple[int, int]:
    """(smallest, largest) number of training rows a cluster, of a sample of n * ratio rows or `least`."""
    sample = min(max(int(n * ratio), least), n)
    return int(sample // k * 0.4), sample // k + 1


def sampled(rows: DataFrame, most: int, n: int, id_col: str = "vec_id") -> DataFrame:
    """About `most` of n rows, those whose draw is smallest: a filter, so nothing is sorted or moved."""
    return rows if most >= n else rows.where(uniform(F.col(id_col)) < most / n)


def numbered(rows: DataFrame, *order: Column | str, name: str = "cid", first: int = 0) -> tuple[DataFrame, int]:
    """(rows with their place in an order as `name`, their number): sorted in ranges, and each range goes on where the one before ends.

    Only the sizes of the ranges come to the driver.
    """
    parts = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    parts = saved(parts.withColumn("__part", F.spark_partition_id()))
    sizes = dict(parts.groupBy("__part").count().collect())
    begin, starts = first, {}
    for part in sorted(sizes):
        starts[part], begin = begin, begin + sizes[part]
    if not sizes:
        return rows.withColumn(name, F.lit(0).cast("long")).limit(0), 0
    offset = F.get(F.array(*(F.lit(starts.get(p, 0)) for p in range(max(sizes) + 1))), F.col("__part"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of a checkpoint's partitions, which stay as they are
    return parts.withColumn(name, (offset + place).cast("long")).drop("__part"), begin - first


def hashed_init(rows: DataFrame, k: int) -> DataFrame:
    """k starting centroids: the rows whose draws are smallest.

    Draws below a bound that lets somewhat more than k rows through are put in order; were
    they fewer than k (draws are even, so that hardly happens), all rows are.
    """
    draw, n = uniform(F.col("vec_id")), rows.count()
    bound = (k + 8 * k**0.5 + 32) / max(n, 1)
    some = rows.select("vec_id", F.col("e").alias("c"), draw.alias("__draw"))
    made, found = numbered(some.where(F.col("__draw") < bound) if bound < 1 else some, "__draw", "vec_id")
    if found < k and bound < 1:
        made, _ = numbered(some, "__draw", "vec_id")
    return made.where(F.col("cid") < k).select("cid", "c")


def kmeans(rows: DataFrame, centroids: DataFrame, iterations: int, metric: str = "l2", spherical: bool = False, balance: float = 0.0) -> DataFrame:
    """(cid, c) after fixed Lloyd iterations; an empty cluster keeps its centroid.

    With `balance` a row's cost in a cluster grows by that much for each member that the
    cluster had in the iteration before.  Centroids within the budget come back to the
    driver after each iteration, so a plan never holds more than one; larger ones are cut
    off by checkpoints.
    """
    spark, kind = rows.sparkSession, centroids.schema["cid"].dataType
    centroids, n = centroids.select("cid", "c"), {}
    penalty = F.col("n") * balance if balance else None
    for _ in range(iterations):
        small = dense.size_of(centroids, "c") <= dense.BROADCAST_BYTES
        if small:
            now = {r.cid: r.c for r in centroids.select("cid", "c").collect()}
            centroids = table_of(spark, now, kind, {c: n.get(c, 0) for c in now})
        elif balance and "n" not in centroids.columns:
            centroids = centroids.withColumn("n", F.lit(0).cast("long"))
        new = means_of_nearest(rows.select("vec_id", "e"), centroids, metric, penalty).select("cid", F.col("c").alias("new"), F.col("n").alias("size"))
        if spherical:
            new = new.withColumn("new", normalized(F.col("new")))
        if small:
            made = new.collect()
            now |= {r.cid: r.new for r in made}
            n = {r.cid: r.size for r in made}
            centroids = table_of(spark, now, kind, {c: n.get(c, 0) for c in now})
        else:
            centroids = saved(centroids.join(new, "cid", "left").select("cid", F.coalesce("new", "c").alias("c"), F.coalesce("size", F.lit(0)).alias("n")))
    return centroids.select("cid", "c")


def clustered(rows: DataFrame, size: int, iterations: int = 5, metric: str = "l2", sample: float = 1.0, balance: float = 0.0, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(centroids (cid, c), rows with cid and dist): clusters of about `size` rows, trained on a share of them.

    Products are clustered by direction.  With `cap` no cluster has more rows than that.
    """
    n = rows.count()
    k = num_centroids(n, size)
    spherical = metric in ("ip", "cosine")
    inner = "ip" if spherical else metric
    if k == 1:
        centroids = means(rows.withColumn("cid", F.lit(0).cast("long")), "cid").select("cid", "c")
        centroids = centroids.withColumn("c", normalized(F.col("c"))) if spherical else centroids
    else:
        least, most = centroid_sizes(n, k, sample)
        some = sampled(rows, most * k if sample < 1 else n, n)
        centroids = kmeans(some, hashed_init(some, k), iterations, inner, spherical, balance)
    if cap is not None and k > 1:
        return centroids, rows.join(capped(rows, centroids, cap, inner), "vec_id")
    return centroids, assign(rows, centroids, inner)


def table_of(spark: SparkSession, centroids: dict, kind, n: dict) -> DataFrame:
    """(cid, c, n) of a few centroids, by Arrow."""
    schema = StructType([StructField("cid", kind), StructField("c", ArrayType(DoubleType())), StructField("n", LongType())])
    ids = sorted(centroids)
    columns = {"cid": pa.array(ids, to_arrow_type(kind)), "c": pa.array([list(centroids[i]) for i in ids], pa.list_(pa.float64())), "n": pa.array([n[i] for i in ids], pa.int64())}
    return spark.createDataFrame(pa.table(columns), schema)


def saved(df: DataFrame) -> DataFrame:
    """df by a checkpoint in the folder that driver and executors share."""
    from ..sources.indexfiles import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """As `saved`, of a size that Spark takes as unknown.

    A checkpoint inherits the estimate of its plan, which is the product of the joined
    tables' estimates: over rounds that join a table with what was made of it, the number
    of digits of that product grows by a factor a round, and with it the driver.
    """
    return unsized(saved(df))


def unsized(df: DataFrame) -> DataFrame:
    """The same rows, of a size that Spark takes as unknown."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def split_small(centroids: DataFrame, least: int) -> DataFrame:
    """Give each cluster below `least` members half of the biggest one, both moved by 1/1024 in opposite directions.

    Centroids (cid, c, n) are few; the steps depend on one another and run on the driver.
    """
    rows = {r.cid: [list(r.c), r.n] for r in centroids.collect()}
    for cid in sorted(rows):
        if rows[cid][1] > least:
            continue
        big = max(rows, key=lambda i: (rows[i][1], -i))
        c, n = rows[big]
        sign = [1 if i % 2 == 0 else -1 for i in range(len(c))]
        rows[cid] = [[x * (1 + s / 1024) for x, s in zip(c, sign)], n // 2]
        rows[big] = [[x * (1 - s / 1024) for x, s in zip(c, sign)], n - n // 2]
    columns = {"cid": pa.array(list(rows), pa.int64()), "c": pa.array([c for c, _ in rows.values()], pa.list_(pa.float64())), "n": pa.array([n for _, n in rows.values()], pa.int64())}
    return centroids.sparkSession.createDataFrame(pa.table(columns))


#: Nearest centroids that a row bids for, rounds of an auction, and steps of a quantile of regrets.
BIDS, ROUNDS, STEPS = 8, 10, 50


def capped(rows: DataFrame, centroids: DataFrame, cap: int, metric: str = "l2", bids: int = BIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cid, dist) with at most `cap` rows a cluster, near the least sum of distances; ids are unique.

    An auction: a row bids for the centroid of least distance plus price among its `bids`
    nearest.  Where more than `cap` bid the price rises by what makes the surplus leave,
    told from quantiles of what each would lose.  After `rounds`, or once no surplus is
    left, each cluster takes those who would lose the most.  The others try the nearest
    centroids with room, round by round: where many wait for the same places they spread
    over the next ones, so equal rows fill several clusters at once.  Only where all
    clusters are full do rows stay out.  Lists are bounded; no table has a row for each
    row and centroid; places within a cluster come from one order of all rows, so a
    cluster that everyone wants is no task's burden.
    """
    spark, kind = rows.sparkSession, centroids.schema["cid"].dataType
    cells = dense.few(centroids, "cid", "c")
    if cells is None:
        raise ValueError("more centroids than may travel: cluster in two levels")
    k, room = len(cells.ids), {int(i): cap for i in cells.ids}
    lists = saved(dense.with_lists(rows, cells, min(bids, k), metric)) if k else None
    placed = spark.createDataFrame([], StructType([rows.schema["vec_id"], StructField("cid", kind), StructField("dist", DoubleType())]))
    if not k or cap < 1:
        return placed
    prices = dict.fromkeys(room, 0.0)
    shares = [i / STEPS for i in range(STEPS + 1)]
    for _ in range(rounds):
        bid = dense.with_bids(lists, prices).groupBy("cid").agg(F.count("*").alias("n"), F.percentile_approx("regret", F.array(*map(F.lit, shares)), 1000).alias("q"))
        surplus = bid.where(F.col("n") > cap).collect()  # a row a centroid at most
        if not surplus:
            break
        for r in surplus:
            rise = r.q[min(STEPS, -(-(r.n - cap) * STEPS // r.n))]
            prices[r.cid] += rise * (1 + 1e-9) + 1e-12 if rise < float("inf") else 0.0
    tried = dense.with_bids(lists, prices)
    waiting = rows.select("vec_id", "e")
    while True:
        order, _ = numbered(tried, "cid", F.desc("regret"), "vec_id", name="place")
        starts, begin = {}, 0
        for r in tried.groupBy("cid").count().orderBy("cid").collect():
            starts[r.cid], begin = begin, begin + r["count"]
        if not starts:
            return placed
        known = spark.createDataFrame([(i, s, room[i]) for i, s in starts.items()], "cid long, start long, room long")
        order = saved(order.join(F.broadcast(known), "cid").withColumn("place", F.col("place") - F.col("start")))
        taken = order.where(F.col("place") < F.col("room"))
        for r in taken.groupBy("cid").count().collect():
            room[r.cid] -= r["count"]
        placed = saved(placed.unionByName(taken.select("vec_id", F.col("cid").cast(kind).alias("cid"), "dist")))
        late = order.where(F.col("place") >= F.col("room")).select("vec_id", ((F.col("place") - F.col("room")) / cap).cast("int").alias("turn"))
        free = [i for i, n in enumerate(cells.ids.tolist()) if room[int(n)] > 0]
        if not free or late.isEmpty():
            return placed
        left = saved(waiting.join(late, "vec_id"))
        waiting = left.select("vec_id", "e")
        open_ = dense.Few(cells.ids[free], cells.x[free], {})
        near = dense.with_lists(waiting, open_, min(bids, len(free)), metric).join(left.select("vec_id", "turn"), "vec_id")
        at = F.pmod(F.col("turn"), F.size("cids")) + 1
        tried = saved(near.select("vec_id", F.element_at("cids", at).alias("cid"), F.element_at("dists", at).alias("dist"), (-F.element_at("dists", at)).alias("regret")))


def histogram(assigned: DataFrame, centroids: DataFrame, key: str = "cid") -> DataFrame:
    """(key, n): sizes, with empty clusters."""
    counts = assigned.groupBy(key).agg(F.count("*").alias("n"))
    return centroids.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def size_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.round(F.avg("n"), 6).alias("avg_n"), F.round(F.stddev_pop("n"), 6).alias("std_n"))


def batches(rows: DataFrame, mini_size: int, megas_of: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(megas, minis, assignment) by id ranges: `mini_size` ids a mini, `megas_of` minis a mega."""
    mini = F.floor(F.col("vec_id") / mini_size).cast("long")
    assignment = rows.withColumn("mini_id", mini)
    minis = dense.local(means(assignment, "mini_id").withColumn("mega_id", F.floor(F.col("mini_id") / megas_of).cast("long")), like=assignment)
    return means_above(minis), minis, assignment


def member_distances(assignment: DataFrame, minis: DataFrame, metric: str = "l2") -> DataFrame:
    """(mini_id, mega_id, vec_id, dist): members and their own centroid."""
    cells = dense.few(minis, "mini_id", "c", ("mega_id",))
    if cells is not None:
        return dense.own_distance(assignment, cells, "mini_id", minis.schema["mega_id"].dataType, metric)
    return assignment.join(minis.select("mini_id", "mega_id", "c"), "mini_id").select("mini_id", "mega_id", "vec_id", distance(metric, "e", "c").alias("dist"))


def silhouettes(rows: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """(vec_id, cid, s): each row (vec_id, e, cid) against its own and the nearest other centroid."""
    cells = dense.few(centroids, "cid", "c")
    if cells is not None:
        return dense.own_and_other(rows, cells, metric).select("vec_id", "cid", silhouette(F.col("a"), F.col("b")).alias("s"))
    other = centroids.select(F.col("cid").alias("ocid"), "c")
    pairs = paired(rows.select("vec_id", "e", "cid"), other).withColumn("d", distance(metric, "e", "c"))
    both = pairs.groupBy("vec_id", "cid").agg(F.min(F.when(F.col("cid") == F.col("ocid"), F.col("d"))).alias("a"), F.min(F.when(F.col("cid") != F.col("ocid"), F.col("d"))).alias("b"))
    return both.select("vec_id", "cid", silhouette(F.col("a"), F.col("b")).alias("s"))


def closer_elsewhere(rows: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """(vec_id, cid, other, dist): rows (vec_id, e, cid) that lie strictly nearer to another centroid than to their own."""
    cells = dense.few(centroids, "cid", "c")
    if cells is not None:
        return dense.own_and_other(rows, cells, metric).where("b < a").select("vec_id", "cid", "other", F.col("b").alias("dist"))
    every = paired(rows.select("vec_id", "e", "cid"), centroids.select(F.col("cid").alias("other"), "c")).withColumn("dist", distance(metric, "e", "c"))
    own = F.min(F.when(F.col("cid") == F.col("other"), F.col("dist"))).alias("a")
    best = every.groupBy("vec_id", "cid").agg(own, F.min(F.when(F.col("cid") != F.col("other"), F.struct("dist", "other"))).alias("b"))
    return best.where("b.dist < a").select("vec_id", "cid", "b.other", "b.dist")


def boundary(minis: DataFrame, megas: DataFrame, most: float = 0.2, metric: str = "l2") -> DataFrame:
    """(mini_id, ratio) of minis that lie about as near to a second mega as to the first."""
    near = probes(minis.select(F.col("mini_id").alias("query_id"), F.col("c").alias("qe")), megas, 2, metric, "mega_id")
    side = lambda r, name: F.max(F.when(F.col("probe_rank") == r, F.col("probe_dist"))).alias(name)
    two = near.groupBy(F.col("query_id").alias("mini_id")).agg(side(1, "d1"), side(2, "d2"))
    return two.select("mini_id", boundary_ratio(F.col("d1"), F.col("d2")).alias("ratio")).where(F.col("ratio") <= most)


def drift(new: DataFrame, old: DataFrame, metric: str = "l2") -> DataFrame:
    """(mega_id, old_id, dist): each new centroid with the nearest one of the previous version."""
    near = assign(new.select("mega_id", F.col("c").alias("e")), old.select(F.col("mega_id").alias("cid"), "c"), metric)
    return near.select("mega_id", F.col("cid").alias("old_id"), "dist")


def insert(rows: DataFrame, megas: DataFrame, minis: DataFrame, metric: str = "l2") -> DataFrame:
    """New rows with their nearest mega and the nearest mini in it; centroids stay."""
    first = assign(rows.select("vec_id", "e"), megas.select(F.col("mega_id").alias("cid"), "c"), metric).select("vec_id", "e", F.col("cid").alias("mega_id"))
    low = dense.few(minis, "mini_id", "c", ("mega_id",))
    if low is not None:
        return dense.nearest_in(first, "mega_id", low, minis.schema["mini_id"].dataType, metric).select("vec_id", "mega_id", "mini_id", "dist")
    cost = first.join(minis.select("mega_id", "mini_id", "c"), "mega_id").withColumn("dist", distance(metric, "e", "c"))
    return cost.groupBy("vec_id", "mega_id").agg(F.min_by(F.struct("mini_id", "dist"), F.struct("dist", "mini_id")).alias("b")).select("vec_id", "mega_id", F.col("b.mini_id").alias("mini_id"), F.col("b.dist").alias("dist"))


def pull(assignment: DataFrame, minis: DataFrame, target: int, neighbours: int, metric: str = "l2") -> DataFrame:
    """(vec_id, mini_id): members of the target's nearest minis that are strictly nearer to the target's centroid."""
    aim = minis.where(F.col("mini_id") == target).select(F.col("c").alias("t"))
    near = minis.where(F.col("mini_id") != target).crossJoin(F.broadcast(aim)).withColumn("dist", distance(metric, "c", "t")).orderBy("dist", "mini_id").limit(neighbours)
    rows = assignment.join(F.broadcast(near.select("mini_id", "c", "t")), "mini_id")
    return rows.where(distance(metric, "e", "t") < distance(metric, "e", "c")).select("vec_id", "mini_id")


def lloyd(x, size: int, iterations: int):
    """Cluster numbers of the rows of one matrix in clusters of about `size`, by Lloyd iterations from evenly spaced rows."""
    import numpy as np

    k = max(1, round(len(x) / size))
    step = min(4096, max(1, dense.CELLS // k))  # a large matrix has more clusters, and no more distances at a time

    def nearest(c):
        half = (c * c).sum(1) / 2
        return np.concatenate([(half - x[at : at + step] @ c.T).argmin(1) for at in range(0, len(x), step)])

    c = x[np.arange(k) * (len(x) // k)]
    for _ in range(iterations):
        own = nearest(c)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return nearest(c)


def recluster_within(assignment: DataFrame, minis: DataFrame, size: int, iterations: int = 5) -> DataFrame:
    """(mega_id, mini_no, vec_id): k-means inside each mega, one task a mega at a time; megas are bounded by maintenance."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        own = lloyd(np.stack(pdf["e"].to_numpy()), size, iterations)
        return pd.DataFrame({"mega_id": pdf["mega_id"], "mini_no": own.astype("int64"), "vec_id": pdf["vec_id"]})

    rows = assignment.join(minis.select("mini_id", "mega_id"), "mini_id").select("mega_id", "vec_id", "e")
    return rows.groupBy("mega_id").applyInPandas(run, "mega_id long, mini_no long, vec_id long")
