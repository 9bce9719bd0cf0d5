"""Documents on their way to training data: each stage takes all that the one before has kept.

Language ID takes out texts without a language; near-duplicates leave one document of each class; texts that leak benchmark items go; secrets
are replaced in the text; what is left is encoded. STAGES lists (name, function); each function takes (spark, docs, sf_dir).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, decontaminate, language_id, minhash, secret_scan
from corvane.llm.queries import remainder, vocabulary_path
from corvane.session import ensure_checkpoint_dir, free_name, remove_at_exit, table

#: From this score on a predicted language is believed.
MIN_LANGUAGE_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null and empty texts and those without a letter go."""
    names = docs.columns
    model = language_id.train(docs.where(remainder(4) != 2))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = language_id.predict(plain, model, text=f"c{names.index('text')}", keep=tuple(plain.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).drop("lang_pred", "score").toDF(*names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without near-duplicates of others; the least doc_id of a class stays."""
    return minhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not contaminated by benchmark items; null and empty texts stay."""
    leak = free_name(docs.columns, "__leak")
    keys = decontaminate.leaking_keys(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("key", leak)
    return docs.join(keys, F.md5(docs["text"]) == F.col(leak), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, found secrets replaced in the text; null and empty texts stay as they are."""
    words = secret_scan.dictionary(docs)
    return secret_scan.redact(docs, secret_scan.train_forest(secret_scan.generated_findings(spark, words), words))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of all rows; null and empty texts have no tokens."""
    return byte_bpe.encode(docs, vocabulary_path(), ids=True)


STAGES = [
    ("language_id", keep_known_language),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode_texts),
]

#: Models and classes of near-duplicates can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder, so lost executors cost no earlier stage."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
