"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Counted as part of
the llm subpackage.

In every stage null text counts as empty, texts of any length are read whole, extra columns of any name
pass through to the last stage, which has columns of its own, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import numbered_columns, restored, stash, table
from corpusmill.llm.line_dedup import without_shared_lines
from corpusmill.llm.mixing import mixed_documents
from corpusmill.llm.packing import best_fit_pack
from corpusmill.llm.quality import score_quality
from corpusmill.llm.queries import vocabulary_path
from corpusmill.llm.simhash import near_duplicate_components


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among those of gone(doc_id)."""
    plain, at = numbered_columns(docs)
    ids = gone.select(F.col("doc_id").alias("gone")).distinct()
    return restored(plain.join(ids, F.col(at["doc_id"]) == F.col("gone"), "left_anti"), docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows without an id stay. Of rows repeated with one id all go if one is rejected."""
    return without(docs, score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are taken out of the texts; documents that lose all their lines go. Rows repeated with one id and text are one document."""
    return without_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8: SimHash links by the generalised pigeonhole, verified, and an exact filter for the rest), the smallest id stays; rows without an id stay, and so do all rows repeated with an id that stays."""
    return without(docs, near_duplicate_components(docs).where("doc_id <> component_id"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents in the passes and word runs that the mix takes. Null is a source; a document without words has no part."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048: one row per piece, with its ids and place. Null ids pass through; repeated rows are packed as often as they stand."""
    return best_fit_pack(docs, vocabulary_path(), capacity=2048, ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

# Trained scores, XXH64 fingerprints, random draws and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
