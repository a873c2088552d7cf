"""What the corpus operators share: input columns, Arrow stages and tables in the shared folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes from which on a size is Spark's guess for a plan that it knows nothing of.
UNKNOWN = 1 << 55


def _size(rows: DataFrame) -> int | None:
    """Bytes of the files that a plan without joins reads, if Spark knows them."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN else None


def partitions(rows: DataFrame, most_bytes: int = 64 << 20) -> int:
    """Partitions for an exchange of a table's rows: the session's number, or more where the table's files ask for it."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(_size(rows) or 0) // most_bytes))


def gathered(rows: DataFrame, like: DataFrame | None = None, least_bytes: int = 8 << 20) -> DataFrame:
    """rows with no more tasks than the cluster has cores, or one for `least_bytes` of `like`, whichever is more.

    Many small files or partitions cost a task each, and files where they are written.
    """
    size = _size(rows if like is None else like)
    most = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // least_bytes))
    return rows.coalesce(most) if size is not None else rows


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, renamed, so that no other column can clash."""
    return gathered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


#: What stands between words of letters, digits and non-ASCII code points, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: str) -> Column:
    """Words of a text column, A-Z in lower case; only the first and the last may be empty."""
    return F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER_CASE, LOWER_CASE), BETWEEN)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is set, as in tests, a single local machine gets one of its own; a cluster
    has no folder to guess.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quiverlake-"))
        at = context.getCheckpointDir()
    return at


_scopes: list[list[str]] = []


@contextlib.contextmanager
def recorded():
    """The paths of the stage tables that are made inside, for `removed` when nothing reads them any more."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete stage tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def stage_table(df: DataFrame, name: str, like: DataFrame | None = None) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation of everything before.  `like`
    is an input table that df does not outgrow; it bounds the number of files.
    """
    spark = df.sparkSession
    df = gathered(df, like, 16 << 20) if like is not None else df
    path = f"{shared_dir(spark)}/quiverlake-stages/{name}-{uuid.uuid4().hex}"
    for made in _scopes[-1:]:
        made.append(path)
    df.write.option("compression", "snappy").parquet(path)  # zstd keeps native memory in every writer
    return spark.read.schema(df.schema).parquet(path)


#: Words of the bitmap of `maybe_in`: it never broadcasts more rows than this.
WORDS = 1 << 20


def maybe_in(df: DataFrame, keys: DataFrame, column: str, flag: str) -> DataFrame:
    """df with a boolean column `flag`: false only where `column` is in no row of `keys` (or null).

    The keys set bits of a bitmap of WORDS 64-bit words, which travels by broadcast; its
    size has a bound whatever the number of keys.  As it fills up more rows are let
    through for nothing, and none is lost: what needs a key's rows still joins them.
    """
    word = F.shiftrightunsigned(F.xxhash64(column), 6) % WORDS
    one = F.expr(f"shiftleft(1L, cast(xxhash64(`{column}`) & 63 as int))")
    bits = keys.where(F.col(column).isNotNull()).groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__bits"))
    there = F.coalesce(F.col("__bits").bitwiseAND(one) != 0, F.lit(False)) & F.col(column).isNotNull()
    return df.withColumn("__at", word).join(F.broadcast(bits), F.col("__at") == F.col("__word"), "left").withColumn(flag, there).drop("__at", "__word", "__bits")


def release() -> None:
    """Give this process's free memory back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


def _released(stage):
    """The stage, giving free memory back to the system at its end: idle Python workers live on beside the next stage."""

    def run(batches):
        try:
            yield from stage(batches)
        finally:
            release()

    return run


#: Rows and bytes of an Arrow batch at most: a batch of texts has a copy in the JVM and several in the Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


def arrow_stage(df: DataFrame, stage, schema) -> DataFrame:
    """df.mapInArrow(stage, schema) that keeps no memory after its tasks.

    Spark reads the bounds of a batch when the stage runs, so they are settings of the
    session: where its own are larger they are lowered to BATCH, and stay so.
    """
    conf, parse = df.sparkSession.conf, df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in BATCH.items():
        if not 0 < parse(conf.get(key)) <= most:
            conf.set(key, most)
    return df.mapInArrow(_released(stage), schema)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """Pieces of a batch with at most `most` bytes of text each (or one row), so that scratch space is bounded."""
    if batch.num_rows == 0:
        return
    lengths = batch.column(column).cast(pa.large_string())
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(lengths), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)
