"""A corpus pipeline of five stages over the documents table.

Each stage takes what the one before it kept, written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import line_dedup, order_minhash, ppm_language, quality
from sievelight.llm.common import discard, scratch, ship_package, staged, with_partner, without_partner
from sievelight.llm.queries import packed_pieces

#: Documents whose language is less certain than this go.
LEAST_SCORE = 0.5


def _renamed(docs: DataFrame) -> DataFrame:
    """The documents with their own columns out of the way of what an operator adds."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c == "text" else f"_own_{c}") for c in docs.columns))


def _own(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*(F.col(f"`{c}`" if c == "text" else f"`_own_{c}`").alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects; null texts fail as empty ones, rows that repeat stay if one does."""
    ship_package(spark)
    judged = quality.apply_policy(quality.ledger(_renamed(docs)), "v1", to="_kept")
    return _own(judged.where("_kept"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; without labelled rows nothing can be judged and all stay.

    Null texts and those without a letter go; rows that repeat are judged alike.
    """
    ship_package(spark)
    model = ppm_language.fit(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs
    judged = ppm_language.predict(_renamed(docs), model)
    return _own(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or nearly repeat an earlier one; a document left without a word goes."""
    clean = line_dedup.without_lines(docs, line_dedup.duplicate_lines(docs))
    clean = clean.where(F.col("text").rlike(r"[^ \t\n\r\x0b\x0c]"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates; equal rows are one document."""
    ship_package(spark)
    judged, row = order_minhash.near_duplicates(docs), ["doc_id", "_digest"]
    judged = judged.withColumnRenamed("digest", "_digest")
    gone = staged(judged.where("NOT kept").select(*row).distinct(), "near-duplicates")
    repeated = staged(judged.where("kept AND doc_id IS NOT NULL").groupBy(*row).count().where("count > 1").select(*row), "near-repeated")
    kept = without_partner(docs.withColumn("_digest", order_minhash.digest_of("text")), gone, row)
    if not repeated.isEmpty():
        one = with_partner(kept, repeated, row).dropDuplicates(row)
        kept = without_partner(kept, repeated, row).unionByName(one)
    return kept.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces packed into sequences of 1024 tokens; null texts are empty ones, rows that repeat documents of their own."""
    ship_package(spark)
    return packed_pieces(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("line dedup", dedup_lines), ("MinHash near-dedup", near_dedup), ("best-fit packing", packing)]

#: Not expressible in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version of the whole chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage stages for itself goes once its result is written
            kept = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), lasting=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
