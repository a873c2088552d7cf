"""A training corpus from `documents`: toxic texts go, near copies go, repeats go, secrets go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents (the last one: packed pieces), which run() writes as Parquet and reads again as
the next stage's docs.

Null texts and ids: a null text is an empty one to every stage, and stays null; a row
without an id is judged on its text where a stage needs no id (toxicity, secrets,
packing) and passes the others unchanged.  Rows that repeat an id are documents by
themselves to every stage: each is scored, compared, cut, scanned and packed on its own
text.  Of equal texts the one with the smallest id stays, of rows that repeat an id any
one.  Long texts are treated whole.  Empty tables give empty results.  Columns beyond
those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm.common import recorded, removed, stage_table, table
from quiverlake.llm.neardup import near_duplicates, numbered
from quiverlake.llm.packing import pack_documents
from quiverlake.llm.queries import LEARN, WORD_MODEL, tokenizer_path
from quiverlake.llm.secrets import find_secrets, redact
from quiverlake.llm.substrings import remove_repeats
from quiverlake.llm.toxicity import fit, score_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    network = fit(docs, table(spark, sf_dir, "labels"), learn=LEARN)
    return score_rows(docs.select(*COLUMNS), network).where("toxicity < 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles: the one with the smallest id.

    A row that repeats an id is a document by itself, which comes after all with an id of their own.
    """
    rows = numbered(docs.select(*COLUMNS))
    gone = near_duplicates(rows, width=5, percent=80, id_col="row_id").where("not kept").select(F.col("doc_id").alias("row_id"))
    return rows.join(gone, "row_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that occur earlier; texts without such windows stay as they are."""
    out = remove_repeats(docs.select(*COLUMNS), carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source", "row.n_chars").withColumn("n_chars", _length())


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced."""
    out = find_secrets(docs, keep=("text", "lang", "source", "n_chars"))
    return out.withColumn("text", redact(F.col("text"), F.col("findings"))).select(*COLUMNS).withColumn("n_chars", _length())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path(WORD_MODEL))


def _length() -> F.Column:
    return F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: No SQL can express a trained network's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    A stage's result is a table; once it stands, the tables that led to it are removed.
    What the last stage reads is left for the owner of the shared folder.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = stage_table(stage(spark, docs, sf_dir), name)
        removed(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
