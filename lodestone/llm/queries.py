"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontam, langmodel, licenses, lines, nearcopies, negatives, oracle, packing, quality, shards, toxicity, urls, wrappers
from .common import shared_dir, table

#: The rules of the url query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer() -> str:
    """The tokenizer file of the queries of token ids, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_dir(spark, "op2")
    shards.write(table(spark, sf_dir, "documents"), tokenizer(), where)
    return shards.read(spark, where, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("body", "class_body")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores, _ = langmodel.fit_and_score(docs, _fold(7) != 2)
    return scores.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: theirs are made of source, language and id, odd ids one directory
    deeper, and a text that begins with a license passes for a license file of its directory."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    deeper = F.when(n % 2 == 1, F.concat(F.lit("e"), (n % 63).cast("string")))
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), (n % 4).cast("string")), deeper, F.concat(F.lit("doc"), n.cast("string")))
    return licenses.scanned(docs.select("doc_id", "text", path.alias("path")), is_license_file=F.col("at") == 0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "judged.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select(
        "doc_id",
        *[F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")],
    )


def _fold(divisor: int):
    """The remainder of crc32(doc_id as text); a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(_fold(5) != 0), labels.where(_fold(5) != 0))
    worst = F.array_max(F.transform("spans", lambda s: F.struct(s["score"].alias("score"), (-s["start"]).alias("first"), s["end"].alias("end"))))
    return (
        toxicity.scored(docs, model)
        .withColumn("worst", worst)
        .select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), (-F.col("worst.first")).alias("worst_start"), F.col("worst.end").alias("worst_end"))
    )


def op11_pq_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrappers.extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_sstable_shards, op3_best_fit_packing, op4_line_dedup, op5_minhash_near_dedup, op6_decontamination, op7_license_scan, op8_url_filter, op9_toxicity, op10_quality_rules, op11_pq_trie, op12_html_extraction, op13_hard_negatives)}
ORACLE_SQL = oracle.SQL
