"""Tool manifests: parsing, rules over single tools and over a manifest's tools."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import corpora, hashing, jsontree
from ..functions import text as T
from ..schemas import TOOL
from ..sources import storage
from . import allowlist, text_rules
from .text_rules import finding


def tools_array(text: Column) -> Column:
    """The tools of a manifest as a JSON array: an object with ``tools``, one wrapped in ``result`` (which goes first), a bare array, or a single tool."""
    return _tools_of(F.try_parse_json(text))


def _tools_of(v: Column) -> Column:
    at = lambda path: F.try_variant_get(v, path, "variant")
    is_array = lambda x: F.startswith(F.schema_of_variant(x), F.lit("ARRAY"))
    return (
        F.when(is_array(at("$.result.tools")), F.to_json(at("$.result.tools")))
        .when(is_array(at("$.result")), F.to_json(at("$.result")))
        .when(is_array(at("$.tools")), F.to_json(at("$.tools")))
        .when(is_array(v), F.to_json(v))
        .when(at("$.name").isNotNull(), F.concat(F.lit("["), F.to_json(v), F.lit("]")))
    )


def parse_tools(manifests: DataFrame, keys: list[str], text: str = "text", deep=jsontree.deep_tools) -> DataFrame:
    """One row per tool: ``ord, name, description, input_schema, annotations`` (the last two as JSON).

    A text without tools gives one row with ``error``.  Texts that are nested too deeply
    for native expressions are read by ``deep``, a function of ``jsontree``.
    """
    schema = f"ARRAY<STRUCT<{TOOL.replace(' STRING', ': STRING')}>>"
    rows = T.once(manifests, _v=F.try_parse_json(F.col(text)))
    rows = T.once(rows, _native=F.from_json(_tools_of(F.col("_v")), schema)).select(*keys, "_native", F.when(F.col("_v").isNull(), F.col(text)).alias("_deep"))
    rows = rows.select(*keys, F.coalesce("_native", deep(F.col("_deep")).cast(schema)).alias("_tools"))
    out = rows.select(*keys, F.col("_tools").isNull().alias("error"), F.posexplode_outer("_tools").alias("ord", "tool"))
    return out.select(
        *keys, "error", "ord", F.col("tool.name").alias("name"), F.col("tool.description").alias("description"),
        F.col("tool.inputSchema").alias("input_schema"), F.col("tool.annotations").alias("annotations"),
    )


def descriptive_text(description: Column, input_schema: Column) -> Column:
    """The description, then every string of the schema."""
    strings = F.coalesce(jsontree.string_values(input_schema), F.array().cast("array<string>"))
    return F.when(input_schema.isNull(), F.coalesce(description, F.lit(""))).otherwise(
        F.array_join(F.concat(F.array(F.coalesce(description, F.lit(""))), strings), " ")
    )


def sensitive_names(names: Column) -> Column:
    """Sorted distinct parameter names that ask for secrets."""
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: T.any_of(T.ascii_lower(n), corpora.SENSITIVE_NAMES))))


def shadowing(tools: DataFrame, manifest: str) -> DataFrame:
    """Names that occur again in a manifest, and names of common builtins: once each, at their first spelling."""
    low = T.ascii_lower(F.col("name"))
    per = Window.partitionBy(manifest, "_low")
    t = tools.withColumn("_low", low).withColumn("_n", F.count("*").over(per)).withColumn("_first", F.row_number().over(per.orderBy("ord")))
    t = t.where("_first = 1")
    rules = [
        F.when(F.col("_n") > 1, finding("HIGH", "tool-shadowing", "another tool has this name", None, -3)),
        F.when(F.col("_low").isin(corpora.COMMON_TOOLS), finding("MEDIUM", "tool-shadowing", "name of a common builtin", None, -2)),
    ]
    t = t.withColumn("findings", F.array_compact(F.array(*rules)))
    return text_rules.rows_of(t, [manifest, "ord"], F.col("name"))


#: Steering texts of a manifest that one task reads, about.
STEERING_ROWS = 20_000


def _first_names(batches):
    """Rows by manifest, salt and kind: names (kind 0), then steering texts (kind 1).  Of each text, the first tool by place that it names, other than its own.

    The automaton of a manifest's names is built as they come; each text is then read once.
    """
    import ahocorasick

    group, names, ready = None, None, False
    for batch in batches:
        found = []
        for m, salt, kind, ord_, name, low, own in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (m, salt) != group:
                group, names, ready = (m, salt), ahocorasick.Automaton(), False
            if kind == 0:
                names.add_word(name, (ord_, name))
                continue
            if not ready:
                names.make_automaton()
                ready = True
            if len(names):
                best = min((v for _, v in names.iter(low) if v[1] != own), default=None)
                if best:
                    found.append((m, ord_, name, best[1]))
        columns = list(zip(*found)) or [()] * 4
        kinds = [batch.schema.field(0).type, batch.schema.field(3).type, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["manifest", "ord", "name", "other"])


def cross_tool(tools: DataFrame, manifest: str, text: str = "desc") -> DataFrame:
    """Tools whose text steers to another tool of their manifest: the first such tool in order.

    Names and steering texts of a manifest meet in one sorted stream, so a task holds the
    names of one manifest and one batch; a manifest with many steering texts is dealt over
    salts, each with all names.  The cost is the size of texts and names, not their product.
    """
    t = tools.withColumn("_low", F.lower(text)).withColumn("_name", T.ascii_lower(F.col("name")))
    steering = t.where(T.any_of(F.col("_low"), corpora.CROSS_TOOL_STEER)).select(manifest, F.col("ord").cast("int").alias("ord"), "name", "_low", F.col("_name").alias("_own"))
    parts = steering.groupBy(F.col(manifest).alias("_m")).agg(F.ceil(F.count("*") / STEERING_ROWS).cast("int").alias("_parts"))
    # One row for each name of a manifest, at its first place.
    others = t.groupBy(F.col(manifest).alias("_m"), F.col("_name").alias("other")).agg(F.min("ord").cast("int").alias("_at")).where(F.octet_length("other") >= 3)
    none = F.lit(None).cast("string")
    dealt = others.join(parts, "_m").select(F.col("_m").alias("m"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("_at").alias("ord"), F.col("other").alias("name"), none.alias("low"), none.alias("own"))
    salt = F.pmod(F.xxhash64("ord", "_low"), F.col("_parts")).cast("int")
    texts = steering.join(parts, steering[manifest] == parts["_m"]).select(F.col("_m").alias("m"), salt.alias("salt"), F.lit(1).alias("kind"), "ord", "name", F.col("_low").alias("low"), F.col("_own").alias("own"))
    stream = dealt.unionByName(texts)
    stream = stream.repartition("m", "salt").sortWithinPartitions("m", "salt", "kind", "ord")
    kind = tools.schema[manifest].dataType.simpleString()
    first = stream.mapInArrow(_first_names, f"manifest {kind}, ord int, name string, other string").withColumnRenamed("manifest", manifest)
    rule = finding("MEDIUM", "cross-tool-trigger", F.concat(F.lit("steers to the tool "), F.col("other")), None, -1)
    return text_rules.rows_of(first.withColumn("findings", F.array(rule)), [manifest, "ord"], F.col("name"))


def tool_rules(names: Column, annotations: Column) -> list[Column]:
    hits = sensitive_names(names)
    return [
        F.when(F.size(hits) > 0, finding("MEDIUM", "sensitive-parameter", "asks for secrets as parameters", F.array_join(hits, ", "), 8)),
        F.when(jsontree.strict_bool(annotations, "destructiveHint"), finding("MEDIUM", "annotation", "declared destructive", None, 9)),
        F.when(jsontree.strict_bool(annotations, "openWorldHint"), finding("INFO", "annotation", "declared to reach outside", None, 10)),
    ]


def scan_tools(tools: DataFrame, manifest: str) -> DataFrame:
    """All findings of parsed tools, with ``severity_rank, ord, check_ord, phrase_ord`` to order them by."""
    tools = tools.where("name is not null")
    tools = tools.withColumn("desc", descriptive_text(F.col("description"), F.col("input_schema"))).withColumn(
        "_params", F.coalesce(jsontree.property_names(F.col("input_schema")), F.array().cast("array<string>"))
    )
    single = text_rules.with_findings(tools, "desc", "name", tool_rules(F.col("_params"), F.col("annotations")))
    out = text_rules.rows_of(single, [manifest, "ord"], F.col("name"))
    return out.unionByName(shadowing(tools, manifest)).unionByName(cross_tool(tools, manifest))


def scan_manifests(manifests: DataFrame, manifest: str, text: str = "text", fingerprints: DataFrame | None = None) -> DataFrame:
    """Findings of manifests; one that holds no tools, or isn't JSON, is a finding itself.

    ``fingerprints``: ``kind, fingerprint``; a manifest that is allowed as ``manifest`` reports only that.
    """
    if fingerprints is not None:
        known, rest = allowlist.split_trusted(manifests.withColumn("fingerprint", hashing.manifest_fingerprint(tools_array(F.col(text)))), fingerprints, "manifest")
        marks = allowlist.trusted_marker(known.select(manifest, F.lit(None).cast("int").alias("ord")), [manifest, "ord"], F.col(manifest).cast("string"))
        return scan_manifests(rest, manifest, text).unionByName(marks)
    tools = parse_tools(manifests, [manifest], text, jsontree.deep_flagged_tools).where("error or name is not null")
    # Four scans read the tools, so manifests are parsed once, into a table.
    path = storage.new_folder(manifests.sparkSession, "tools")
    tools.write.parquet(path)
    tools = manifests.sparkSession.read.schema(tools.schema).parquet(path)
    unread = [F.when(F.col("error"), finding("HIGH", "unreadable-manifest", "no tools can be read from it", None, -9))]
    return scan_tools(tools, manifest).unionByName(text_rules.scan_rules(tools.where("error"), [manifest, "ord"], unread, F.col(manifest).cast("string")))
