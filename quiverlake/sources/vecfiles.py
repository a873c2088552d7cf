"""Vector files as DataFrames: fvecs, bvecs, ivecs, fbin and raw arrays of numbers, by the data source `vectors`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectorsource import RAW, WHOLE, VectorFiles
from .vectorsource import kind_of as kind_of


def _format(spark: SparkSession, way, **options):
    spark.dataSource.register(VectorFiles)
    return way.format("vectors").options(**{k: v for k, v in options.items() if v is not None})


def read(spark: SparkSession, path: str, kind: str | None = None, max_rows: int | None = None, files: int | None = None, split_bytes: int | None = None, ids: str = "file") -> DataFrame:
    """(file, vec_id, embedding) of a file or a folder of them.

    The ending tells the kind where none is given.  vec_id is the position in the file, or
    with ids="all" the position in all files in order of name.  `max_rows` counts for each
    file of any kind, and no more is read; `files` takes the first so many in order of
    name.  A split has `split_bytes` bytes.
    """
    return _format(spark, spark.read, kind=kind, maxrows=max_rows, maxfiles=files, splitbytes=split_bytes, ids=ids).load(path)


def read_raw(spark: SparkSession, path: str, kind: str, width: int, names: tuple[str, str, str] = ("query_id", "pos", "value")) -> DataFrame:
    """(row, position, value) of a raw array of numbers, `width` a row: ground truth (uint64) or masks (uint8).

    A file that is not a whole number of rows is refused.
    """
    if kind not in RAW or width < 1:
        raise ValueError("a raw array has a kind and a width")
    rows = _format(spark, spark.read, kind=kind, width=width, ids="all").load(path)
    row, pos, value = names
    return rows.select(F.col("vec_id").alias(row), F.posexplode("embedding").alias("p", value)).select(row, F.col("p").cast("long").alias(pos), value)


def write_raw(rows: DataFrame, path: str, kind: str, row: str = "query_id", pos: str = "pos", value: str = "value", parts: int = 1) -> None:
    """Raw arrays in order of row and position."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("long").alias("v"))))
    each = rows.groupBy(F.col(row).alias("vec_id")).agg(F.transform(cells, lambda s: s["v"]).alias("embedding"))
    write(each, path, kind, parts)


def paths(folder: str, selectivity: int) -> dict[str, str]:
    """Names of a filtered search's files."""
    return {"mask": f"{folder}/mask_{selectivity}.bin", "truth": f"{folder}/gt_{selectivity}.bin", "queries": f"{folder}/queries.fvecs"}


def chunk(rows: DataFrame, number: int, of: int, n: int, id_col: str = "vec_id") -> DataFrame:
    """Chunk `number` of `of` equal ranges of ids 0 .. n - 1; the last one has the rest."""
    size = n // of
    return rows.where((F.col(id_col) >= number * size) & (F.col(id_col) < (n if number == of - 1 else (number + 1) * size)))


def random_vectors(spark: SparkSession, n: int, dim: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(vec_id, embedding): uniform vectors that every run repeats."""
    draw = lambda i: F.pmod(F.xxhash64("id", i), F.lit(1 << 24)) / float(1 << 24) * (high - low) + low
    return spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), draw).cast("array<float>").alias("embedding"))


def write_results(rows: DataFrame, path: str) -> None:
    """Rows of a run as JSON, an object a line."""
    rows.write.mode("overwrite").json(path)


def write(rows: DataFrame, path: str, kind: str, parts: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Files part-N.<kind> in id order, `parts` at most; each task writes its own."""
    values = F.col(vector_col).cast("array<long>" if kind in WHOLE else "array<float>").alias("embedding")
    ordered = rows.select(F.col(id_col).alias("vec_id"), values).repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    _format(rows.sparkSession, ordered.write.mode("overwrite"), kind=kind).save(path)
