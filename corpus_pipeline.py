"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; its result is written as Parquet and read again as the next one's ``docs``.
All stages but the last return the columns of ``documents``.

Defined results of every stage: null and empty texts are documents (the toxicity stage
scores them by its intercept; of several, exact dedup keeps one; they link with nothing;
they have no words, so the mix takes none of them); a null id is kept apart by its row
and sorts below all others in exact dedup, above in near dedup; ties and repeated rows
are copies, of which one row stays; a null source is a source of its own; null labels
teach nothing, and without labels all documents stay; an empty table goes through as
an empty one; extra columns of any name stay until packing; texts of any length are
worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from cinderlake.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells rows apart: the id, or a staged row number where ids repeat or are null."""
    repeated = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs, "doc_id"
    row = "_row"
    while row in docs.columns:
        row += "_"
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(docs: DataFrame, rows: DataFrame, row: str, groups: DataFrame, best) -> DataFrame:
    """Of each group (``row_id, group_id``) the row that ``best`` picks from ids and row numbers stays."""
    ids = rows.select(F.col("doc_id").alias("id"), F.col(row).alias("row_id"))
    groups = staged(groups.join(ids, "row_id"), "grouped")
    keep = staged(groups.groupBy("group_id").agg(best.alias("best")).select(F.col("best.row_id").alias("row_id")), "keep")
    dropped = staged(groups.select("row_id").join(keep, "row_id", "left_anti"), "dropped")
    return rows.join(dropped, rows[row] == dropped["row_id"], "left_anti").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest id stays; a null id sorts below all others."""
    rows, row = _rows(docs)
    verdict = exact_dedup.exact_dedup(rows, id_col=row)
    if row == "doc_id":
        return docs.join(verdict.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    groups = verdict.where("group_size > 1").select(F.col("doc_id").alias("row_id"), F.col("keep_id").alias("group_id"))
    return _without(docs, rows, row, groups, F.max(F.struct("id", "row_id")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, one row with the smallest id stays; a null id sorts above all others."""
    rows, row = _rows(docs)
    found = ngram_join.ngram_join(rows, id_col=row)
    if row == "doc_id":
        dropped = staged(found.where("component_id <> doc_id").select("doc_id"), "near-dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    groups = found.select(F.col("doc_id").alias("row_id"), F.col("component_id").alias("group_id"))
    return _without(docs, rows, row, groups, F.min(F.struct(F.col("id").isNull(), "id", "row_id")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

#: The trained classifier and the packing are no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i + 1}")
    return docs
