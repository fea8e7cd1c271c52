"""Sinks: SARIF, flat findings, locks, baselines, guardrails."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from . import storage

TOOL = "cinderlake"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def severity_level(severity: Column) -> Column:
    return F.when(severity == "HIGH", "error").when(severity == "MEDIUM", "warning").otherwise("note")


def verdict_level(verdict: Column) -> Column:
    return F.when(verdict.isin("MALICIOUS", "MISSING", "LOOKALIKE"), "error").when(verdict.isin("VULNERABLE", "SUSPICIOUS"), "warning").otherwise("note")


def trust_level(trust: Column) -> Column:
    return F.when(trust == "AVOID", "error").when(trust == "REVIEW", "warning").otherwise("note")


def finding_results(findings: DataFrame, command: str, source: Column) -> DataFrame:
    """``rule_id, level, message, file, logical`` of findings.  Standard input has no file."""
    file = F.when(source.isin("", "-", "stdin"), None).otherwise(source)
    message = F.when(F.col("evidence").isNull(), F.col("message")).otherwise(F.concat("message", F.lit(" ["), "evidence", F.lit("]")))
    return findings.select(
        F.concat(F.lit(f"{TOOL}/{command}/"), "category").alias("rule_id"), severity_level(F.col("severity")).alias("level"), message.alias("message"), file.alias("file"), F.col("tool").alias("logical")
    )


def verdict_results(reports: DataFrame, file: str | None = None) -> DataFrame:
    """Of flagged packages only."""
    shown = names.display_name(F.col("name"), F.col("version"))
    return reports.where("verdict <> 'OK'").select(
        F.concat(F.lit(f"{TOOL}/verify/"), F.lower("verdict")).alias("rule_id"), verdict_level(F.col("verdict")).alias("level"),
        F.concat(shown, F.lit(" ("), "ecosystem", F.lit("): "), "reason").alias("message"), F.lit(file).cast("string").alias("file"), shown.alias("logical"),
    )


def trust_results(reports: DataFrame, command: str, name: Column) -> DataFrame:
    """A headline for each report that isn't GREEN."""
    return reports.where("trust <> 'GREEN'").select(
        F.concat(F.lit(f"{TOOL}/{command}/"), F.lower("trust")).alias("rule_id"), trust_level(F.col("trust")).alias("level"), F.concat(name, F.lit(" is "), F.lower("trust")).alias("message"),
        F.lit(None).cast("string").alias("file"), name.alias("logical"),
    )


def drift_results(changes: DataFrame) -> DataFrame:
    return changes.select(
        F.concat(F.lit(f"{TOOL}/drift/"), "kind").alias("rule_id"), severity_level(F.col("severity")).alias("level"), "message", F.col("path").alias("file"), F.col("tool").alias("logical")
    )


def foresee_results(classified: DataFrame, manifest: Column) -> DataFrame:
    """A result for each planted trap, at the ``manifest`` whose names were predicted."""
    message = F.concat(F.lit("the predicted name "), "name", F.lit(" is registered, "), F.lower("verdict"), F.lit(": "), "reason")
    return classified.where("trap").select(
        F.lit(f"{TOOL}/foresee/trap").alias("rule_id"), verdict_level(F.col("verdict")).alias("level"), message.alias("message"), manifest.alias("file"), F.col("name").alias("logical")
    )


def first_seen_rules(results: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rule ids in the order in which they first occur."""
    first = results.groupBy("rule_id").agg(F.min(F.struct(*order)).alias("_at"))
    place = F.row_number().over(Window.orderBy("_at", "rule_id")) - 1
    return first.select(place.alias("rule_index"), "rule_id", names.rule_slug(F.col("rule_id")).alias("short"))


def result_json(results: DataFrame) -> DataFrame:
    """One SARIF result object per row, for a writer of text files."""
    physical = F.when(F.col("file").isNotNull(), F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation")))
    logical = F.when(F.col("logical").isNotNull(), F.array(F.struct(F.col("logical").alias("name"))))
    row = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(physical.alias("physicalLocation"), logical.alias("logicalLocations"))).alias("locations"))
    return results.select(F.to_json(row).alias("value"))


def flat_json(results: DataFrame) -> DataFrame:
    """A plain object per finding, nulls kept."""
    row = F.struct(F.col("rule_id").alias("rule"), "level", "message", "file", F.col("logical").alias("name"))
    return results.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def _head(rules: DataFrame) -> str:
    """A document up to its results; rules are a short list."""
    listed = [{"id": r.rule_id, "shortDescription": {"text": r.short}} for r in rules.orderBy("rule_index").toLocalIterator()]
    run = json.dumps({"tool": {"driver": {"name": TOOL, "rules": listed}}})[:-1]
    return f'{{"$schema":{json.dumps(SARIF_SCHEMA)},"version":"2.1.0","runs":[{run},"results":['


def _separated(batches):
    """Lines with a comma before each but the first of a partition."""
    comma = ""
    for batch in batches:
        lines = [f",{v}" for v in batch["value"]]
        if lines:
            lines[0] = lines[0] if comma else lines[0][1:]
            comma = ","
            yield pd.DataFrame({"value": lines})


def write_sarif(results: DataFrame, rules: DataFrame, path: str) -> str:
    """One SARIF document, ``results.sarif`` in ``path``, from many tasks.

    Each partition writes its results as a part without head and tail, in the order in which it has them; the document is
    the parts joined in order, as streams, and renamed into place when it is whole.  No task, and not the driver, holds
    all results.
    """
    spark, parts = results.sparkSession, f"{path}/parts"
    result_json(results).mapInPandas(_separated, "value string").write.mode("overwrite").text(parts)
    pieces: list = [_head(rules)]
    for name in storage.names(spark, parts):
        if name.startswith("part-") and storage.size(spark, f"{parts}/{name}"):
            pieces += ["," if len(pieces) > 1 else "", (f"{parts}/{name}",)]
    storage.concatenated(spark, f"{path}/results.sarif", [*pieces, "]}]}"])
    storage.remove(spark, parts)
    return f"{path}/results.sarif"


def write_sarif_parts(results: DataFrame, rules: DataFrame, path: str) -> None:
    """A complete SARIF document a partition, where a reader takes many files."""
    first = _head(rules)

    def document(batches):
        yield pd.DataFrame({"value": [first]})
        yield from _separated(batches)
        yield pd.DataFrame({"value": ["]}]}"]})

    result_json(results).mapInPandas(document, "value string").write.mode("overwrite").text(path)


def write_lock(tools: DataFrame, path: str) -> None:
    """A lock: version 1, tools by source and name, one JSON line each."""
    ordered = tools.withColumn("version", F.lit(1)).repartitionByRange("path", "name").sortWithinPartitions("path", "name")
    ordered.write.mode("overwrite").json(path)


def read_lock(spark, path: str) -> DataFrame:
    return spark.read.schema("path string, name string, description string, input_schema string, annotations string, version int").json(path)


def write_baseline(snapshot: DataFrame, path: str) -> None:
    snapshot.distinct().repartitionByRange("kind", "value").sortWithinPartitions("kind", "value").write.mode("overwrite").json(path)


def read_baseline(spark, path: str) -> DataFrame:
    return spark.read.schema("kind string, value string").json(path)


def guardrail_lines(classified: DataFrame) -> DataFrame:
    """A JSON line for each name not to install and each planted trap, in order, of any number of reports."""
    lists = F.array_compact(F.array(F.when(F.col("guard"), F.lit("do_not_install")), F.when(F.col("trap"), F.lit("planted_traps"))))
    rows = classified.select("ecosystem", F.explode(lists).alias("list"), "name").distinct()
    return rows.repartitionByRange("ecosystem", "list", "name").sortWithinPartitions("ecosystem", "list", "name").select(F.to_json(F.struct("ecosystem", "list", "name")).alias("value"))


def guardrail(classified: DataFrame, key: str = "ecosystem") -> DataFrame:
    """One JSON document a key: names not to install and planted traps.  For predicted names, of which a key has at most 80; ``guardrail_lines`` takes any number."""
    pick = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(F.col(c), F.col("name")))))
    per = classified.groupBy(*dict.fromkeys([key, "ecosystem"])).agg(pick("guard").alias("do_not_install"), pick("trap").alias("planted_traps"))
    note = F.lit("names that a model may make up; don't install them")
    return per.select(key, F.to_json(F.struct(note.alias("note"), "ecosystem", "do_not_install", "planted_traps")).alias("value"))


def report_json(reports: DataFrame) -> DataFrame:
    """Package reports, without nulls and empty lists."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    ids = F.transform("vulnerabilities", lambda v: v["id"])
    row = F.struct("ecosystem", "name", "version", "verdict", "reason", "latest_version", "created", "downloads", some("malicious_ids").alias("malicious_ids"), F.when(F.size(ids) > 0, ids).alias("vulnerability_ids"))
    return reports.select(F.to_json(row).alias("value"))


def text_line(findings: DataFrame) -> DataFrame:
    """A line of text per finding."""
    return findings.select(F.concat_ws("  ", F.rpad("severity", 6, " "), F.rpad("category", 20, " "), F.coalesce("tool", F.lit("-")), "message", "evidence").alias("value"))
