"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chat, decontamination, packing, pii, quality_model, quality_rules, secrets, simhash, tokens, toxicity, urls
from docloom.llm.common import crc_mod, documents, table
from docloom.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed values: (host, path, verdict) of the URL rules.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _digest(spans: Column) -> Column:
    """'kind:start:end' of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.token_pieces(documents(spark, sf_dir), vocabulary(), max_tokens=4096, end_id=1)
    return packing.pack_documents(pieces, capacity=4096)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: What both turns of the extra conversation say.
ESCAPE_CASE = "\\### Assistant: </turn> ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ESCAPE_CASE).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url and outcome of the pages: a page shows the document that its path ends in, good if labelled of quality and not toxic."""
    _, path = urls.url_parts(F.col("url"))
    shown = table(spark, sf_dir, "pages").select("url", F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long").alias("doc_id"))
    good = (F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")) >= 0.5).cast("int")
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(good.alias("outcome"))
    return shown.join(known, "doc_id", "left").select("url", "outcome")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = urls.reputation(labelled_pages(spark, sf_dir))
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, rates)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir), words_path=vocabulary())
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), F.size("values").cast("long").alias("n_values"), F.array_max(F.transform("values", lambda v: v["bits"])).alias("most_bits"), F.size(F.filter("values", lambda v: v["bits"] < secrets.WEAK_BITS)).cast("long").alias("n_weak"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), radius=4)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("pii")).alias("spans"), pii.in_context(F.col("pii")).cast("long").alias("n_in_context"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _labels(spark: SparkSession, sf_dir: str, mod: int, held: int) -> DataFrame:
    """The labels, without those of held-out documents."""
    return table(spark, sf_dir, "labels").filter(crc_mod("doc_id", mod) != held)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, _labels(spark, sf_dir, 3, 1))
    return toxicity.score(docs, model, limit=0.7).withColumn("held_out", crc_mod("doc_id", 3) == 1)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model.fit(docs, _labels(spark, sf_dir, 5, 0))
    return toxicity.score(docs, model, limit=0.3).withColumn("held_out", crc_mod("doc_id", 5) == 0)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_packing, op2_decontamination, op3_chat_formatting, op4_url_filters, op5_secret_scans, op6_simhash_near_dedup, op7_pii, op8_quality_rules, op9_toxicity, op10_quality_classifier)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
