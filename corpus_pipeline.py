"""From raw documents to packed training sequences, in five stages that each write a table and read it again.

All stages take whole texts of any length, null and empty ones too, tables without rows, null and repeated doc_ids, and
columns beside those of documents whatever their names; all but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common, decontamination, jaccard_join, packing, secrets
from tidewater.llm import toxicity as tox


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learnt from the labels, scores at 0.5 or more go.

    Null and empty texts score as texts without any match; repeated rows share their fate. Without labels of both
    classes nothing is learnt, and all stay.
    """
    model = tox.fit(docs, common.table(spark, sf_dir, "labels"))
    score = "__tox_score"
    return tox.score_rows(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays: that of the least doc_id, in one row.

    Null and empty texts are similar to nothing and stay, repeated ones too; of documents without a doc_id, a row of each
    text stays where no doc_id is in their component.
    """
    return jaccard_join.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go, all rows of them; null and empty texts hold none and stay, and
    so does everything where the benchmark is empty."""
    return decontamination.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are masked in the text, and n_chars follows; all rows stay, null texts as they are."""
    return secrets.hide_live_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences: rows of pieces, not of documents.

    A null or empty text is a piece of the end id alone; repeated rows are packed as often as they stand; of equally long
    pieces the least doc_id comes first. An empty table gives no pieces.
    """
    return packing.pack(packing.token_pieces(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("hide_secrets", hide_secrets), ("pack", pack)]

#: SQL can't express the stages (learnt models, tokenizers); tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
