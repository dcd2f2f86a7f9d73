"""From documents to packed training sequences, over the operators of ``assayline.llm``.

Stages, each on all that the one before kept: drop toxic documents, take out repeated lines,
keep one document of each group of near-duplicates, drop documents that leak benchmark items,
pack the rest. All but the last return the columns of their input, with ``n_chars`` brought up to
date where the text changes. A document that loses all its lines stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayline.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from assayline.llm.common import remainder, text_key, written
from assayline.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; the model learns from the labels outside the held-out fifth."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=remainder(F.col("doc_id"), 5) != 0)
    return _returned(toxicity.score(_carried(docs), model).where("toxic = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line: any line but a blank one if equal, one of eight words and more up to one word."""
    cleaned = _returned(line_dedup.deduplicate_lines(_carried(docs), least_words=1), docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of five-word shingles the document with the smallest id; texts without words all stay."""
    found = near_dedup.near_duplicates(docs, words=5, percent=80)
    grouped = found.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("text_key")).alias("apart"))
    best = grouped.agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best")).select(
        F.col("best.no_id").alias("_no_id"), F.coalesce("best.doc_id", F.lit(0)).alias("_id"), F.col("best.text_key").alias("_tk"))
    keys = ["_no_id", "_id", "_tk"]
    keyed = docs.select(
        F.struct(*_columns(docs)).alias("_row"), F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"),
        text_key(F.col("text")).alias("_tk"), (F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "").alias("_empty"))
    # Rows equal in id and text share a key: one of them stays.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    chosen = keyed.where("NOT _empty").join(best, keys, "left_semi").withColumn("_copy", first).where("_copy = 1")
    return chosen.select("_row.*").union(keyed.where("_empty").select("_row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    marked = decontamination.mark_leaks(_carried(docs), table(spark, sf_dir, "benchmark"))
    return _returned(marked.where(F.size("leaks") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_file(), capacity=4096, end_id=1)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{name}`") for name in docs.columns]


OWN = ("doc_id", "text")


def _carried(docs: DataFrame) -> DataFrame:
    """Id and text for an operator, all other columns in one, so that none meets a column the operator adds."""
    rest = [F.col(f"`{name}`") for name in docs.columns if name not in OWN]
    return docs.select(*OWN, F.struct(*rest, F.lit(True).alias("_")).alias("carried"))


def _returned(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as they were, with the text as it is in ``rows``."""
    return rows.select(*[F.col(name) if name in OWN else F.col("carried")[name].alias(name) for name in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# A trained model, edit distances and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
