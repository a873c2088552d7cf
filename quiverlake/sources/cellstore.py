"""An index kept as cells of vectors: a step writes the cells it changes and nothing else.

    path/cells/v=N/cell=C/    vectors (vec_id, e, mini_no) of a mega, written by step N
    path/megas/N/             which cells make up the index after step N: (mega_id, cell, v, n, minis)
    path/steps/N/             what step N did, measured while it ran, as one JSON line; it ends the step

A mega's place in the index (`mega_id`) and the ids of its minis (`minis`, by number in the
cell) are in the list of cells, not with the vectors.  So ids are handed out again, and
megas move to other ids, without rewriting a vector: a step's new megas and minis first
take the ids of those that go, then ids after the last; where fewer come than go, the last
ones move into the holes.  Ids so stay 0 .. n - 1.

A step that fails before its last file leaves the version before in force; its files are
overwritten by the next step of that number.  Old versions can be read until `vacuum`.
One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import numbered, saved

INDEX = ("vec_id", "e", "mini_id", "mega_id")
MEGAS = "mega_id long, cell long, v int, n long, minis array<long>"
#: Cells that a read names one by one; more are picked by a join.
NAMED = 4096


@dataclass
class Step:
    """A step's number, which old ids (of megas and minis) have moved where, and what was written."""

    version: int
    megas: DataFrame  # old_id, new_id
    minis: DataFrame
    rows: int
    bytes: int


def filled(kept: DataFrame, gone: DataFrame, fresh: DataFrame, id_col: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """(fresh with ids, moves (old_id, new_id)): fresh rows take the ids of `gone` in order, then ids after the last; else the last of `kept` fill the holes.

    Ids of kept and gone together are 0 .. n - 1.
    """
    free, went = numbered(gone.select(F.col(id_col).alias("id")), "id", name="no")
    fresh, came = numbered(fresh, *order, name="no")
    last = kept.count() + went
    given = fresh.join(free, "no", "left").withColumn(id_col, F.coalesce("id", F.col("no") + (last - went)).cast("long")).drop("no", "id")
    left = last - went + came
    holes, _ = numbered(free.where((F.col("no") >= came) & (F.col("id") < left)).select(F.col("id").alias("new_id")), "new_id", name="no")
    moving, _ = numbered(kept.where(F.col(id_col) >= left).select(F.col(id_col).alias("old_id")), "old_id", name="no")
    return given, moving.join(holes, "no").select("old_id", "new_id")


class CellStore:
    """The cells of an index under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path
        return at, at(self.path).getFileSystem(conf)

    @property
    def version(self) -> int:
        """The last whole step; -1 without any."""
        at, files = self._files()
        if not files.exists(at(f"{self.path}/steps")):
            return -1
        found = [int(s.getPath().getName()) for s in files.listStatus(at(f"{self.path}/steps")) if files.exists(at(f"{s.getPath()}/_SUCCESS"))]
        return max(found, default=-1)

    def megas(self, version: int | None = None) -> DataFrame:
        """(mega_id, cell, v, n, minis) of a version."""
        version = self.version if version is None else version
        return self.spark.read.schema(MEGAS).parquet(f"{self.path}/megas/{version}") if version >= 0 else self.spark.createDataFrame([], MEGAS)

    def rows(self, megas: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The index (vec_id, e, mini_id, mega_id), or that of some megas (mega_id): only their cells are read."""
        live = self.megas(version)
        if megas is not None:
            live = live.join(megas.select("mega_id").distinct(), "mega_id", "left_semi")
        few = live.select("v", "cell").limit(NAMED + 1).collect()
        if not few:
            return self.spark.createDataFrame([], "vec_id long, e array<double>, mini_id long, mega_id long")
        cells = self.spark.read.schema("vec_id long, e array<double>, mini_no int, v int, cell long").parquet(f"{self.path}/cells")
        if len(few) <= NAMED:
            cells = cells.where(F.col("v").isin(sorted({r.v for r in few})) & F.col("cell").isin(sorted(r.cell for r in few)))  # a cell is in one version
        return cells.join(live.select("cell", "mega_id", "minis"), "cell").select("vec_id", "e", F.get("minis", F.col("mini_no")).alias("mini_id"), "mega_id")

    def replace(self, gone: DataFrame, new: DataFrame) -> Step:
        """One step: the megas of `gone` (mega_id) go, the megas of `new` (vec_id, e, mini_id, mega_id) come, under ids of their own.

        The ids in `new` only say what belongs together.
        """
        version, old = self.version + 1, self.megas()
        gone = saved(gone.select("mega_id").distinct())
        kept, went = old.join(gone, "mega_id", "left_anti"), old.join(gone, "mega_id", "left_semi")
        new = saved(new.select("vec_id", "e", F.col("mini_id").alias("mini"), F.col("mega_id").alias("mega")))
        minis = saved(new.groupBy("mega", "mini").agg(F.count("*").alias("n")))
        inside = minis.groupBy("mega").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("mini")).alias("own"))  # a mega's minis are few
        each = lambda df: df.select(F.explode("minis").alias("mini_id"))
        given, mini_moves = filled(each(kept), each(went), minis.select("mega", "mini"), "mini_id", "mega", "mini")
        fresh, mega_moves = filled(kept.select("mega_id"), went.select("mega_id"), inside, "mega_id", "mega")
        fresh, _ = numbered(fresh, "mega", name="cell", first=version << 32)  # no cell of another step has such a number
        ids = given.groupBy("mega").agg(F.transform(F.array_sort(F.collect_list(F.struct("mini", "mini_id"))), lambda s: s["mini_id"]).alias("minis"))
        fresh = saved(fresh.join(ids, "mega"))
        mini_moves, mega_moves = saved(mini_moves), saved(mega_moves)
        # Vectors of the new cells, counted as they are written.
        seen = Observation()
        out = new.join(fresh.select("mega", "cell", "own"), "mega").select("vec_id", "e", (F.array_position("own", F.col("mini")) - 1).cast("int").alias("mini_no"), "cell")
        out = out.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.size("e").cast("long") * 4), F.lit(0)).alias("bytes"))
        out.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells/v={version}")
        wrote = seen.get
        # The list of cells: kept ones under their old or moved ids, and the new ones.
        moved = kept.select("mega_id", "cell", "v", "n", F.posexplode("minis").alias("no", "mini_id")).join(mini_moves.withColumnRenamed("old_id", "mini_id"), "mini_id", "left")
        moved = moved.groupBy("mega_id", "cell", "v", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", F.coalesce("new_id", "mini_id").alias("id")))), lambda s: s["id"]).alias("minis"))
        moved = moved.join(mega_moves.withColumnRenamed("old_id", "mega_id"), "mega_id", "left").select(F.coalesce("new_id", "mega_id").alias("mega_id"), "cell", "v", "n", "minis")
        made = fresh.select("mega_id", "cell", F.lit(version).alias("v"), "n", "minis")
        moved.unionByName(made).write.mode("overwrite").parquet(f"{self.path}/megas/{version}")
        done = {"version": version, "rows": wrote["rows"], "bytes": wrote["bytes"], "megas_in": inside.count(), "megas_out": went.count(), "megas_moved": mega_moves.count()}
        self.spark.range(1).select(F.lit(json.dumps(done)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/steps/{version}")
        return Step(version, mega_moves, mini_moves, wrote["rows"], wrote["bytes"])

    def append(self, new: DataFrame) -> Step:
        """One step that only adds megas."""
        return self.replace(self.megas().select("mega_id").limit(0), new)

    def history(self) -> DataFrame:
        """(version, rows, bytes, megas_in, megas_out, megas_moved): what each step wrote, as observed while it was written."""
        schema = "version int, rows long, bytes long, megas_in long, megas_out long, megas_moved long"
        return self.spark.read.schema(schema).json(f"{self.path}/steps/*").where(F.col("version") <= self.version)

    def vacuum(self) -> int:
        """Delete the lists of older versions and the cells that the present one doesn't use; returns the number of cells."""
        at, files = self._files()
        version, live = self.version, {(r.v, r.cell) for r in self.megas().select("v", "cell").toLocalIterator()}
        gone = 0
        for step in files.listStatus(at(f"{self.path}/cells")):
            v = int(step.getPath().getName().split("=")[1])
            for cell in files.listStatus(step.getPath()):
                name = cell.getPath().getName()
                if name.startswith("cell=") and (v, int(name.split("=")[1])) not in live:
                    files.delete(cell.getPath(), True)
                    gone += 1
        for old in files.listStatus(at(f"{self.path}/megas")):
            if int(old.getPath().getName()) != version:
                files.delete(old.getPath(), True)
        return gone
