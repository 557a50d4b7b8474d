"""A training corpus from raw documents: language, near duplicates, benchmark passages, secrets, packed sequences.

Every stage takes all that the one before it kept, as a table written under the shared checkpoint folder. Stages 1 to 4 return the columns of
documents; the last one returns the pieces of packed token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, near, packing, secret_scan
from tidemark.llm.graph import put_back, set_aside
from tidemark.llm.tokens import vocabulary
from tidemark.session import scratch_dir

#: A text is taken for noise if the highest probability of its windows, whichever language it is for, is below this on average.
LEAST_SCORE = 0.3
#: Texts whose word shingles have this similarity (Jaccard, per cent) or more are near duplicates.
SIMILAR = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without letters, and texts whose windows stay under LEAST_SCORE. `lang` becomes the
    predicted one, of a text in several languages the one with the highest mean."""
    found = langid.predict(set_aside(docs), langid.learn(docs), text="body", certainty="certainty")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_SCORE))
    return put_back(kept, docs.columns, new={"lang": F.col("lang_pred")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (SIMILAR or more) stays: the one with the smallest doc_id."""
    return near.deduplicate(spark, docs, percent=SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if a twentieth of their words or more lies in benchmark passages; rows that share an id are judged by their own texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.matches(spark, docs, benchmark)
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    same = F.col("id").cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce("body", F.lit(""))) == F.col("bad_hash"))
    return put_back(set_aside(docs).join(bad, same, "left_anti"), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret is replaced by a mark; n_chars follows the new text."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2,048 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 1, keep_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Models and tokenizers have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's documents."""
    folder = scratch_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
