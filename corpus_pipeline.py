"""A corpus in five stages: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns documents for the next one; the
last returns packed pieces.  ``run`` writes what each stage keeps as Parquet into the
shared folder and reads it again.

Defined results, in all stages: an empty table stays empty; columns beyond those of documents are dropped; a null text
counts as an empty one where it is judged and stays null; rows that repeat are judged each, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the line field finds good.

    A score of exactly a half stays; without labels of both classes every score is a half, so all stay.  A null or empty text is judged
    as one empty line.
    """
    from roadflow.llm.quality import fit, held_out, score

    field = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs.select(*COLUMNS), field, COLUMNS, out="quality_score").where("quality_score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: the smallest id, of several texts under it the one with the smallest hash.

    Texts without words are components of their own and stay.  Rows that repeat both id and text are one document and stay or go
    together; rows without an id go if their component has one with an id, and all stay otherwise.
    """
    from roadflow.llm.jaccard import near_duplicates as join

    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("_v"))
    groups = Scratch(spark, "near-duplicates").save(join(marked, ["doc_id", "_v"]))
    first = groups.where("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "_v")).alias("m")).select("m.doc_id", "m._v")
    nameless = groups.where("component_id is null").select("doc_id", "_v").distinct()
    kept = first.unionByName(nameless).withColumnsRenamed({"doc_id": "_id", "_v": "_kept"})
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_v") == F.col("_kept")), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the benchmark does not contaminate; texts without words, and all texts without benchmark items, stay."""
    from roadflow.llm.decontamination import contaminated, find_contamination

    found = find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(~contaminated()).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every row stays, and n_chars follows the new text (null for a null text)."""
    from roadflow.llm.pii import redact

    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into windows of 2048 tokens; a null or empty text is one piece of one token."""
    from roadflow.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return scratch.save(STAGES[-1][1](spark, docs, sf_dir))


#: Models and tokens can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None
