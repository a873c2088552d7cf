"""Numbers of rows and dimensions of Parquet tables of vectors from their footers; no vector is read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectorsource import store_of

GROUPS = "file string, row_group int, n_rows long, n_values long"


def row_groups(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """(file, row_group, n_rows, n_values): a row for each row group, n_values being the components of its vectors (a null or empty vector counts one).

    Names come from Spark's listing; tasks read the footers, some files each.
    """
    names = spark.read.parquet(path).inputFiles()
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, min(len(names), int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, at = store_of(name)
                with store.open_input_file(at) as source:
                    meta = pq.ParquetFile(source).metadata
                    leaf = next((i for i in range(meta.num_columns) if meta.schema.column(i).path.split(".")[0] == vector), None)
                    if leaf is None:
                        raise ValueError(f"no column {vector} in {name}")
                    groups = [(name, g, meta.row_group(g).num_rows, meta.row_group(g).column(leaf).num_values) for g in range(meta.num_row_groups)]
                columns = list(zip(*groups)) or [[]] * 4
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "row_group", "n_rows", "n_values"])

    return files.mapInArrow(run, GROUPS)


def table_stats(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """(n_files, n_rows, dim): dim is null where the row groups cannot all have vectors of one dimension."""
    groups = row_groups(spark, path, vector).where("n_rows > 0")
    dim = F.col("n_values") / F.col("n_rows")
    one = F.when((F.min(dim) == F.max(dim)) & (F.max(dim) == F.floor(F.max(dim))), F.max(dim).cast("int"))
    return groups.agg(F.count_distinct("file").alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), one.alias("dim"))
