"""Allowlists: exact pins of packages and fingerprints of artifacts.  Never a name alone."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_rules

PACKAGES = "ecosystem string, name string, version string, note string"
FINGERPRINTS = "kind string, id string, fingerprint string, note string"


def parse(spark: SparkSession, text: str | None) -> tuple[DataFrame, DataFrame]:
    """Both tables from the TOML store; none is an empty store, and text that isn't TOML is an error."""
    doc = tomllib.loads(text or "")
    pkgs = [(p["ecosystem"], p["name"], v, p.get("note")) for p in doc.get("packages", {}).values() for v in p.get("versions", [])]
    fps = [(f["kind"], f.get("id"), f["fingerprint"], f.get("note")) for f in doc.get("fingerprints", {}).values()]
    return spark.createDataFrame(pkgs, PACKAGES), spark.createDataFrame(fps, FINGERPRINTS)


def rows_by_key(packages: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The store as it is listed: keys in order, versions sorted and distinct."""
    p = packages.groupBy(F.concat_ws(":", "ecosystem", "name").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("version")), ", ").alias("value"), F.first("note", ignorenulls=True).alias("note"))
    f = fingerprints.select(F.concat_ws(":", "kind", "fingerprint").alias("key"), F.col("id").alias("value"), "note")
    return p.unionByName(f).orderBy("key")


def render(packages: DataFrame, fingerprints: DataFrame) -> str:
    """TOML of the store."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = []
    by: dict = {}
    for r in sorted(packages.collect(), key=lambda r: (r.ecosystem, r.name, r.version)):
        by.setdefault((r.ecosystem, r.name), []).append(r)
    for (eco, name), rows in by.items():
        out += [f"[packages.{quote(f'{eco}:{name}')}]", f"ecosystem = {quote(eco)}", f"name = {quote(name)}", "versions = [" + ", ".join(dict.fromkeys(quote(r.version) for r in rows)) + "]"]
        out += [f"note = {quote(n)}" for n in {r.note for r in rows if r.note}][:1]
    for r in sorted(fingerprints.collect(), key=lambda r: (r.kind, r.fingerprint)):
        out += [f"[fingerprints.{quote(f'{r.kind}:{r.fingerprint}')}]", f"kind = {quote(r.kind)}", f"id = {quote(r.id or '')}", f"fingerprint = {quote(r.fingerprint)}"]
        out += [f"note = {quote(r.note)}"] if r.note else []
    return "\n".join(out) + "\n" if out else ""


def add(store: DataFrame, rows: DataFrame) -> DataFrame:
    return store.unionByName(rows).dropDuplicates([c for c in store.columns if c != "note"])


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows that agree with ``keys`` in its columns."""
    return store.join(keys.distinct(), keys.columns, "left_anti").select(*store.columns)


def clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


def split_trusted(artifacts: DataFrame, fingerprints: DataFrame, kind: str, column: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """Artifacts whose fingerprint is allowed for their kind, and the others, which are to be scanned."""
    allowed = fingerprints.where(F.col("kind") == kind).select(F.col("fingerprint").alias("_fp")).distinct()
    on = F.col(column) == F.col("_fp")
    return artifacts.join(allowed, on, "left_semi"), artifacts.join(allowed, on, "left_anti")


def trusted_marker(artifacts: DataFrame, keys: list[str], tool: Column) -> DataFrame:
    """What a trusted artifact reports instead of findings: one row, shaped like them."""
    return text_rules.scan_rules(artifacts, keys, [text_rules.finding("INFO", "trusted", "on the allowlist by its fingerprint", None, -9)], tool)
