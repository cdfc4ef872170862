"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgrid.llm.chat import format_chats, read_loss, read_turns
from lossgrid.llm.common import read_table
from lossgrid.llm.decontaminate import contained_items
from lossgrid.llm.exact_dedup import exact_dedup
from lossgrid.llm.fill_middle import fill_in_middle, restored
from lossgrid.llm.language import identify
from lossgrid.llm.line_dedup import remove_repeated_passages
from lossgrid.llm.packing import pack_documents
from lossgrid.llm.quality import classify
from lossgrid.llm.resample import importance_resample
from lossgrid.llm.simhash import near_dedup
from lossgrid.llm.suffix_dedup import remove_repeats
from lossgrid.llm.token_counts import lines, section_tokens
from lossgrid.llm.warc import round_trip


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Per piece of a document its place in sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its text without the passages of lines that an earlier place has."""
    return remove_repeated_passages(read_table(spark, folder, "documents")).select("doc_id", "text", "lines_removed")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per line of each document the tokens of the whole text that are attributed to it."""
    return section_tokens(read_table(spark, folder, "documents"), lines())


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a document and a benchmark item whose five-word shingles it contains to 0.8 or more."""
    return contained_items(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the row of its group of equal texts that stays."""
    return exact_dedup(read_table(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document what is left when repeats of 50 bytes and more of earlier documents are cut out."""
    return remove_repeats(read_table(spark, folder, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its fingerprint and the smallest doc_id that it links to."""
    return near_dedup(read_table(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its quality score, learned from the labels outside the held-out fold."""
    return classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Per page its record, after all pages were written to archives and read back."""
    return round_trip(read_table(spark, folder, "pages"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the language with the largest estimated proportion."""
    return identify(read_table(spark, folder, "documents"))


def op11_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Per conversation the digests of its turns and of its loss texts, read back from the formatted text."""
    chats = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = format_chats(chats.unionByName(hard)).select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its form for infilling, with digests of the output and of the text restored from it."""
    out = fill_in_middle(read_table(spark, folder, "documents"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its importance for the benchmark's words, and its place among the documents drawn."""
    return importance_resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_line_dedup,
        op3_token_counts,
        op4_benchmark_decontamination,
        op5_exact_dedup,
        op6_suffix_dedup,
        op7_simhash_near_dedup,
        op8_quality_classifier,
        op9_warc,
        op10_language_id,
        op11_chat_formatting,
        op12_fill_in_middle,
        op13_importance_resampling,
    )
}
