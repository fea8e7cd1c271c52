"""Mixing sources to target weights, in DataFrame operations only.

Capped water-filling: sources share a total in proportion to their weights, no
source above ``max_epochs`` times its own size.  A source whose share passes its
cap is clamped there, and what it gives up is shared again among the others in
proportion to their weights, until no share passes a cap.  Clamping in ascending
order of cap / weight reaches that fixed point in one pass: when sources are in
this order, source k is clamped exactly if the level (total - caps clamped so
far) / (weights left) times its weight exceeds its cap.

Sampling: a source with target t and size s takes every document floor(t / s)
times, and the rest, t - floor(t / s) * s words, once more from documents in a
seeded order (by md5 of seed and id).  The document on which the rest ends is
taken in part, so the words taken from a source equal floor(t).

Prefix sums of that order are taken in two levels.  Words are summed by (source,
slot of the order), 1024 slots to a source; a window runs over these sums only,
and a second one over the documents of the one slot in which a source's rest
ends.  A hot source is thus dealt over its slots, and no task ever sorts a source.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; sources of size 0 have target 0; documents of one id tie and are
ordered by size; an empty table gives an empty result; other columns stay.  Texts are
counted whole by native functions, so a long one costs its own row's memory only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SLOT_HEX = 3  # 16 ** 3 slots in md5 hex digits, cut to 1024 below
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: one row per source (``source, source_size``), a small table.  Adds ``target``."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("long")).withColumn("cap", max_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("left_total", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(onward))
        .withColumn("clamped", F.col("weight") * F.col("left_total") >= F.col("cap") * F.col("left_weight"))
    )
    # The level at the first source that isn't clamped holds for all after it.
    first = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("left_total"), F.col("left_weight")))).over(whole)
    return s.withColumn("level", first).select(
        "source",
        "source_size",
        F.when(F.col("clamped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("level.left_total").cast("double") / F.col("level.left_weight"))
        .alias("target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` has ``doc_id, source, size``.  Adds ``source_size, target, taken`` (words).

    Columns of these names in ``docs`` are replaced, other columns stay, whatever
    their names.
    """
    own = ["doc_id", "source", "size"]
    others = [c for c in docs.columns if c not in (*own, "source_size", "target", "taken")]
    docs = docs.select(*own, *([F.struct(*others).alias("_others")] if others else []))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.withColumn("_key", key).withColumn(
        "_slot", (F.conv(F.substring("_key", 1, SLOT_HEX), 16, 10).cast("int") % 1024)
    )
    # Null sources are told apart by a flag, so that joins stay plain equalities.
    rows = rows.withColumn("_none", F.col("source").isNull()).withColumn("_src", F.coalesce("source", F.lit("")))
    slots = staged(
        rows.groupBy("_none", "_src", "_slot").agg(F.sum("size").alias("slot_size"), F.count("*").alias("n")), "mix-slots"
    )
    sizes = slots.groupBy("_none", "_src").agg(F.sum("slot_size").alias("source_size")).select(
        F.when(~F.col("_none"), F.col("_src")).alias("source"), "source_size"
    )
    targets = staged(water_fill(sizes, weights, max_epochs), "mix-targets").select(
        F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src"), "source_size", "target"
    )
    upto = Window.partitionBy("_none", "_src").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = (
        slots.join(targets, ["_none", "_src"])
        .withColumn("_before", F.coalesce(F.sum("slot_size").over(upto), F.lit(0)))
        .withColumn("_whole", whole)
        .withColumn("_rest", F.floor("target").cast("long") - F.col("_whole") * F.col("source_size"))
        # What of the rest falls to this slot: all of its words, none, or the cut.
        .withColumn("_slot_rest", F.greatest(F.lit(0), F.least("slot_size", F.col("_rest") - F.col("_before"))))
        .select("_none", "_src", "_slot", "source_size", "target", "_whole", "_slot_rest", "slot_size")
    )
    plan = staged(plan, "mix-plan")
    out = rows.join(plan, ["_none", "_src", "_slot"])
    is_cut = (F.col("_slot_rest") > 0) & (F.col("_slot_rest") < F.col("slot_size"))
    inside = Window.partitionBy("_none", "_src", "_slot").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = out.where(is_cut).withColumn("_ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.withColumn("_more", F.greatest(F.lit(0), F.least("size", F.col("_slot_rest") - F.col("_ahead")))).drop("_ahead")
    even = out.where(~is_cut).withColumn("_more", F.when(F.col("_slot_rest") > 0, F.col("size")).otherwise(F.lit(0)).cast("long"))
    both = even.unionByName(cut).withColumn("taken", F.col("_whole") * F.col("size") + F.col("_more"))
    return both.select(*own, *(["_others.*"] if others else []), "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, in the columns of ``docs``.

    A repetition that is taken in part holds the words that are taken, with the
    white space between them.
    """
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.struct("*").alias("_row"))
    picked = mix(rows, **options).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = picked.withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    part = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, part.cast("int")), "")
    text = F.when(part < F.col("size"), head).otherwise(F.col("_row.text"))
    cols = [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*cols)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), p AS (
  SELECT *, ('0x' || substr(k, 1, 3))::INT % 1024 AS slot FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM p GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
  SELECT *,
    (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_total,
    (sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_weight
  FROM w
), c AS (
  SELECT *, weight * left_total >= cap * left_weight AS clamped FROM o
), f AS (
  SELECT left_total AS lt, left_weight AS lw FROM c WHERE NOT clamped ORDER BY cap / weight, left_total, left_weight LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE weight * lt::DOUBLE / lw END AS target
  FROM c LEFT JOIN f ON true
), r AS (
  SELECT p.doc_id, p.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(p.size) OVER (PARTITION BY p.source ORDER BY p.slot, p.k, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken
FROM r
"""
