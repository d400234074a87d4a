"""From raw documents to packed sequences: toxicity, near duplicates, secrets, packing.

Every stage takes all rows that its predecessor kept. The first three return the columns of
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm import neardup, packing, secrets, toxicity
from inkflow.llm.common import stage, table

#: Dropped ids sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: The Jaccard index, in hundredths, from which documents are near duplicates here (op4_neardup has its own).
PERCENT = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns; it learns from the labelled rows outside the held-out fold.

    A null text is judged as an empty one; rows without doc_id and rows that repeat are judged like others. Without labels, or
    documents for them, every score is 0.5 and all stay. No rows give none.
    """
    weights = toxicity.train(docs, table(spark, sf_dir, "labels").filter(toxicity.fold() != 1))
    return toxicity.accepted(docs, weights)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id, and all others without a duplicate.

    Null and empty texts are no duplicates. Rows that repeat a doc_id are one document, and stay or go together; rows without
    doc_id stay. Columns are kept, also those whose names the operator uses. No rows give none.
    """
    dropped = stage(neardup.near_duplicates(docs, PERCENT).filter("not kept").select("doc_id"))
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars to match; other columns stay.

    A null text stays null and keeps its n_chars; repeated rows and rows without doc_id are treated like others. No rows give none.
    """
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; see packing.pack.

    A null text is empty: one piece, the end's id. Repeated rows, and rows without doc_id, are documents of their own. Other
    columns are left behind. No rows give none.
    """
    return packing.pack(stage(packing.pieces(docs)))


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("secrets", without_secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
