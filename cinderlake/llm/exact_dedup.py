"""Exact deduplication by progressive refinement, in DataFrame operations only.

Three levels, each over what the level before could not tell apart:

1. rows are counted by the length of their text in bytes;
2. rows whose length occurs again, by length and a hash of a short prefix;
3. rows that still share both are read again in full, and grouped by length and
   the SHA-256 of the whole normalised text.

A row that is alone at any level is done: its full text is never hashed.
Lower-casing A-Z keeps the length in bytes, so level 1 needs no normalisation.

Counts are pre-aggregated before each shuffle.  The tables of counts are staged,
which leaves plain exchanges on both sides of the joins that carry them back to
the rows: Spark broadcasts a table whose measured size allows it, and otherwise
splits the partitions of a hot length, prefix or text.

Defined results: a null text counts as the empty text; equal texts keep the row
with the largest id; an empty table gives an empty result; repeated rows of one id
are each returned, each counted in ``group_size``, and kept or dropped together; a
null id sorts below all others; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, staged, table

PREFIX_CHARS = 64


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, with_digest: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept``; ``text_sha256`` on demand, which hashes every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    length, prefix = F.octet_length("text").alias("len"), F.xxhash64(ascii_lower(F.substring("text", 1, prefix_chars))).alias("prefix")
    digest = F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest")
    rows = staged(src.select("doc_id", length, prefix, *([digest] if with_digest else [])), "dedup-rows")
    lengths = staged(rows.groupBy("len").count().where("count > 1").select("len"), "dedup-lengths")
    again = rows.join(lengths, "len", "left_semi")
    prefixes = staged(
        again.groupBy("len", "prefix").count().where("count > 1").select("len", "prefix"), "dedup-prefixes"
    )
    if with_digest:
        full = staged(again.join(prefixes, ["len", "prefix"], "left_semi"), "dedup-full")
    else:
        alike = staged(again.join(prefixes, ["len", "prefix"], "left_semi").select("doc_id").distinct(), "dedup-alike")
        full = staged(
            src.join(alike.withColumnRenamed("doc_id", "alike_id"), F.col("doc_id").eqNullSafe(F.col("alike_id")), "left_semi").select(
                "doc_id", length, prefix, digest
            ),
            "dedup-full",
        )
        # Other rows of these ids were read as well.
        full = full.join(prefixes, ["len", "prefix"], "left_semi")
    groups = staged(
        full.groupBy("len", "digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "dedup-groups",
    )
    sha = [F.lower(F.hex("digest")).alias("text_sha256")] if with_digest else []
    alone = rows.join(prefixes, ["len", "prefix"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *sha
    )
    is_alone = F.col("group_size").isNull()
    grouped = full.join(groups, ["len", "digest"], "left").select(
        "doc_id",
        F.when(is_alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (is_alone | F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        *sha,
    )
    return alone.unionByName(grouped)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_digest=True)


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
