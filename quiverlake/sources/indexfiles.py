"""Saving and loading an index: one Parquet folder a table, and its settings as JSON."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is set, as in tests, a single local machine gets one of its own; a cluster
    has no folder to guess.  Checkpoints go there too.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = at or tempfile.mkdtemp(prefix="quiverlake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged_rows(df: DataFrame, path: str) -> DataFrame:
    """df written to a folder and read back: lineage ends there, sizes are those of its files, and its shuffle files go once it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def save(path: str, settings: dict, layout: dict[str, str] | None = None, **tables: DataFrame) -> None:
    """A folder a table, laid out by the column that `layout` names for it (a search then skips the cells it does not probe).

    The settings are written last: a folder without them is not a whole index.
    """
    layout = layout or {}
    for name, df in tables.items():
        by = layout.get(name)
        out = df.repartition(by).write.partitionBy(by) if by else df.write
        out.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    types = {name: df.schema[by].dataType.simpleString() for name, by in layout.items() if name in tables for df in (tables[name],)}
    said = {"tables": sorted(tables), "settings": settings, "layout": layout, "types": types}
    spark.range(1).select(F.lit(json.dumps(said)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """(settings, tables by name)."""
    found = json.loads(spark.read.text(f"{path}/settings").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in found["tables"]}
    for name, by in found["layout"].items():
        tables[name] = tables[name].withColumn(by, F.col(by).cast(found["types"][name]))
    return found["settings"], tables


def staged(path: str, batch: DataFrame) -> None:
    """Append a batch of rows to an index's buffer."""
    batch.write.mode("append").parquet(f"{path}/buffer")


def buffer(spark: SparkSession, path: str, schema: str = "vec_id long, e array<double>") -> DataFrame:
    """What has been staged; nothing where nothing has."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/buffer")
    there = at.getFileSystem(conf).exists(at)
    return spark.read.schema(schema).parquet(f"{path}/buffer") if there else spark.createDataFrame([], schema)


def cleared(spark: SparkSession, path: str) -> None:
    """Empty the buffer, after its rows have been merged and the index saved."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/buffer")
    at.getFileSystem(conf).delete(at, True)
