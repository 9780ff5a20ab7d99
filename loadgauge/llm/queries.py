"""The operators as registered queries, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadgauge.llm import (
    chat,
    collocations,
    html_extract,
    language,
    mixing,
    neighbours,
    pieces,
    quality,
    simhash,
    substrings,
    token_counts,
    warc,
    whitening,
)
from loadgauge.llm.common import n_words_of, table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, n_words_of(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    turns = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), turns.alias("t")).select("conv_id", "t.turn", "t.role", said)
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("damage")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_report(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids", "decodes")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_chat_format": op2_chat_format,
    "op3_warc": op3_warc,
    "op4_nearest": op4_nearest,
    "op5_quality_cascade": op5_quality_cascade,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language": op7_language,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_main_text": op10_main_text,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}
