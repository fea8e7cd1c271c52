"""Drift: a committed lock or snapshot against what is there now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import corpora, jsontree
from ..functions import text as T
from ..schemas import rank
from . import text_rules

CHANGE = ["path", "tool", "kind", "severity", "message", "evidence"]


def locked_tools(tools: DataFrame) -> DataFrame:
    """``path, ord, name, description, input_schema, annotations``: the first tool of each name."""
    place = F.row_number().over(Window.partitionBy("path", "name").orderBy("ord"))
    return tools.withColumn("_p", place).where("_p = 1").drop("_p", "ord")


def with_escalation(df: DataFrame, old: Column, new: Column, beside: dict[str, Column]) -> DataFrame:
    """Adds ``escalation``: the worst signal of the new text that the old one hasn't, else LOW.  ``beside``: more columns, made in the same projection.

    Signals are compared by category and severity, so one phrase for another isn't
    an escalation.
    """
    df = df.withColumns({"_old": old, "_new": new, "_old_label": F.lit("old"), "_new_label": F.lit("new")})
    df = text_rules.with_all_signals(df, {"_was": ("_old", "_old_label"), "_is": ("_new", "_new_label")}, beside)
    fresh = F.array_min(F.transform(F.array_except("_is", "_was"), lambda s: s["rank"]))
    severity = F.when(fresh == 0, "HIGH").when(fresh == 1, "MEDIUM").otherwise("LOW")
    return df.withColumn("escalation", severity).drop("_old", "_new", "_old_label", "_new_label", "_was", "_is")


def hints(annotations: Column, side: str) -> dict[str, Column]:
    return {f"{h}_{side}": jsontree.strict_bool(annotations, h) for h in ("readOnlyHint", "destructiveHint")}


def annotation_severity() -> Column:
    """By the ``hints`` of annotations that are JSON."""
    hint = lambda h, side: F.when(F.col(f"annotations_json_{side}").isNotNull(), F.col(f"{h}_{side}"))
    dropped = hint("readOnlyHint", "a").eqNullSafe(True) & hint("readOnlyHint", "b").eqNullSafe(False)
    destructive = ~hint("destructiveHint", "a").eqNullSafe(True) & hint("destructiveHint", "b").eqNullSafe(True)
    return F.when(dropped | destructive, "HIGH").otherwise("LOW")


def _change(kind: str, severity: str | Column, message: str | Column, evidence: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(kind).alias("kind"), lit(severity).alias("severity"), lit(message).alias("message"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"))


def diff_sources(locked: DataFrame, current: DataFrame) -> DataFrame:
    """``path`` of each side, distinct: sources that came or went."""
    a, b = locked.select(F.col("path").alias("p1")).distinct(), current.select(F.col("path").alias("p2")).distinct()
    both = a.join(b, F.col("p1") == F.col("p2"), "full").where("p1 is null or p2 is null")
    change = F.when(F.col("p2").isNull(), _change("source-removed", "MEDIUM", "source is gone")).otherwise(_change("source-added", "MEDIUM", "source isn't in the lock"))
    return both.select(F.coalesce("p1", "p2").alias("path"), F.lit("-").alias("tool"), change.alias("c")).select("path", "tool", "c.*")


def diff_tools(locked: DataFrame, current: DataFrame) -> DataFrame:
    """Tools of sources on both sides; those of an added or removed source aren't expanded."""
    paths = locked.select("path").distinct().join(current.select("path").distinct(), "path")
    side = lambda df, s: df.join(paths, "path", "left_semi").select(*[F.col(c).alias(f"{c}_{s}") for c in ("path", "name", "description", "input_schema", "annotations")])
    both = side(locked, "a").join(side(current, "b"), (F.col("path_a") == F.col("path_b")) & (F.col("name_a") == F.col("name_b")), "full")
    same = F.col("name_a").isNotNull() & F.col("name_b").isNotNull()
    differ = lambda x: same & ~F.col(f"{x}_a").eqNullSafe(F.col(f"{x}_b"))
    # Tools that are equal as written end here, and only texts that differ are read.
    both = both.where(~same | differ("description") | differ("input_schema") | differ("annotations"))
    seen = lambda x, s: F.when(differ(x), F.col(f"{x}_{s}"))
    read = {f"{x}_json_{s}": jsontree.canonical_json(seen(x, s)) for x in ("input_schema", "annotations") for s in "ab"}
    read |= hints(seen("annotations", "a"), "a") | hints(seen("annotations", "b"), "b")
    both = with_escalation(both, seen("description", "a"), seen("description", "b"), read)
    changes = [
        F.when(F.col("name_b").isNull(), _change("tool-removed", "MEDIUM", "tool is gone")),
        F.when(F.col("name_a").isNull(), _change("tool-added", "MEDIUM", "tool isn't in the lock")),
        F.when(differ("description"), _change("description-changed", F.col("escalation"), "description changed", T.truncated(F.col("description_b"), 120, "..."))),
        F.when(differ("annotations_json"), _change("annotation-changed", annotation_severity(), "annotations changed", T.truncated(F.col("annotations_json_b"), 120, "..."))),
        F.when(differ("input_schema_json"), _change("schema-changed", "MEDIUM", "a parameter came, went or changed its type")),
    ]
    rows = both.select(F.coalesce("path_a", "path_b").alias("path"), F.coalesce("name_a", "name_b").alias("tool"), F.inline(F.array_compact(F.array(*changes))))
    return rows.select(*CHANGE)


def drift(locked: DataFrame, current: DataFrame) -> DataFrame:
    """All changes with ``severity_rank``."""
    out = diff_sources(locked, current).select(*CHANGE).unionByName(diff_tools(locked, current))
    return out.withColumn("severity_rank", rank(F.col("severity"), corpora.SEVERITIES))


def documents(changes: DataFrame) -> DataFrame:
    """One JSON document per source: ``lock, document`` with ``{lock, changes[]}``, worst changes first.  A document is as long as its source has tools."""
    rows = changes.groupBy(F.col("path").alias("lock")).agg(F.sort_array(F.collect_list(F.struct("severity_rank", "tool", "kind", "severity", "message", "evidence"))).alias("changes"))
    kept = F.transform("changes", lambda c: F.struct(c["severity"].alias("severity"), c["kind"].alias("kind"), c["tool"].alias("tool"), c["message"].alias("message"), c["evidence"].alias("evidence")))
    return rows.select("lock", F.to_json(F.struct("lock", kept.alias("changes"))).alias("document"))


def snapshot_additions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``kind, value`` that the baseline hasn't.  What went isn't reported."""
    return current.select("kind", "value").distinct().join(baseline, ["kind", "value"], "left_anti")
