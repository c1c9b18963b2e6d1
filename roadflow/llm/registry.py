"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 2048 tokens."""
    from roadflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that an earlier document has, removed from every document."""
    from roadflow.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    from roadflow.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    from roadflow.llm.quality import fit, held_out, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = fit(docs, labels.where(~held_out()))
    scored = score(docs, field, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on the corpus."""
    from roadflow.llm.lm import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs), ["doc_id"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    from roadflow.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a sound file, sniffed, read back and described."""
    from roadflow.llm.media import store_documents

    return store_documents(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, and whether they contaminate it."""
    from roadflow.llm.decontamination import contaminated, find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict for the url of every page."""
    from roadflow.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), ["page_id"])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    from roadflow.llm.pii import KINDS, find, joined

    found = find(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language by their weakest cut."""
    from roadflow.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, and components of those within two bits."""
    from roadflow.llm.simhash import near_copies

    return near_copies(table(spark, sf_dir, "documents"), ["doc_id"])


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for infilling, and rebuilt from what came out."""
    from roadflow.llm.middle import rearrange, restore

    made = restore(rearrange(table(spark, sf_dir, "documents"), ["doc_id"]))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from roadflow.llm.collocations import collocations_sql
    from roadflow.llm.middle import middle_sql
    from roadflow.llm.urls import filter_sql

    return {"op9_url_filter": filter_sql(), "op11_collocations": collocations_sql(), "op13_middle": middle_sql()}
