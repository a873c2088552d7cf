"""The corpus queries opN_<name> over whole tables; `oracles` has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import ORACLE_SQL as ORACLE_SQL

PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _spans(found: str) -> F.Column:
    return F.array_join(F.transform(F.col(found), lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def _count(found: str, kind: str) -> F.Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("begins", "ends").alias("spans_hash"))


def op2_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, scale=64.0).drop("depth")


#: Rows whose labels may be learned from.
LEARN = "pmod(crc32(cast(doc_id as string)), 5) <> 0"


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels"), learn=LEARN))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import find_licenses

    return find_licenses(table(spark, sf_dir, "documents"))


def op5_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    base = ("email", "ip", "card", "phone")
    out = find_personal_data(table(spark, sf_dir, "documents")).withColumn("base", F.filter("findings", lambda f: f["kind"].isin(*base)))
    return out.select("doc_id", *(_count("findings", k) for k in base), F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("findings").alias("spans"))


def op7_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jpeg import media_columns

    out = media_columns(table(spark, sf_dir, "documents"))
    size = F.octet_length("payload")
    return out.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, octet_length(payload) - 31, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "height", "width", F.crc32("rgb").alias("rgb_crc32"))


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    out = find_secrets(table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    out = out.withColumn("base", F.filter("findings", lambda f: f["kind"].isin(*base)))
    return out.select("doc_id", *(_count("findings", k) for k in base), F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("findings").alias("spans"))


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_MODEL))


def op11_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_no_random_access": op2_no_random_access,
    "op3_toxicity": op3_toxicity,
    "op4_license_windows": op4_license_windows,
    "op5_super_minhash": op5_super_minhash,
    "op6_pii": op6_pii,
    "op7_super_kmers": op7_super_kmers,
    "op8_progressive_jpeg": op8_progressive_jpeg,
    "op9_hilbert_packing": op9_hilbert_packing,
    "op10_markov_secrets": op10_markov_secrets,
    "op11_inverted_treaps": op11_inverted_treaps,
    "op12_neighbourhoods": op12_neighbourhoods,
    "op13_prefix_decontamination": op13_prefix_decontamination,
}
