"""The queries of the subpackage: thin digests over its operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import byte_bpe, decontaminate, language_id, maxent_lm, minhash, ogg_media, pii, pu_quality, secret_scan, token_counts


def remainder(divisor: int, column: str = "doc_id"):
    """crc32 of the column as text, modulo the divisor."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; keep is true for the least doc_id of a class."""
    found = minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("keep"))


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and model score of every document, learned from those whose remainder by 7 isn't 2."""
    return maxent_lm.score(table(spark, sf_dir, "documents"), remainder(7) != 2)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts.count(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; spans has the disclosing terms after the base spans."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    base = pii.listed(F.col("base"))
    terms = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.array_join(F.filter(F.array(base, terms), lambda x: x != ""), ",")
    return found.select("doc_id", *map(count, range(4)), F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.size("terms").cast("long").alias("n_term"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document that the forest, trained from generated labelled findings, keeps."""
    docs = table(spark, sf_dir, "documents")
    words = secret_scan.dictionary(docs)
    forest = secret_scan.train_forest(secret_scan.generated_findings(spark, words), words)
    return secret_scan.report(docs, forest)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in windows of benchmark items."""
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 8) k, w[i:i + least(len(w), 8) - 1] g from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, i, k, w[i:i + k - 1] g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, ks where len(w) >= k)),
hit as (select doc_id, item_id, i, k from dw join bw using (k, g)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from hit)) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, cast(item_id as varchar) item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an Ogg file and read back."""
    return ogg_media.store(table(spark, sf_dir, "documents"), media=False)


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of those whose remainder by 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(3) == 1
    model = pu_quality.train(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return pu_quality.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder by 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(4) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup, "op2_maxent_lm": op2_maxent_lm, "op3_token_counts": op3_token_counts, "op4_byte_bpe": op4_byte_bpe, "op5_pii": op5_pii, "op6_secret_scan": op6_secret_scan, "op7_decontaminate": op7_decontaminate, "op8_ogg_media": op8_ogg_media, "op9_pu_quality": op9_pu_quality, "op10_language_id": op10_language_id}

ORACLE_SQL: dict[str, str] = {"op7_decontaminate": OP7_SQL}
