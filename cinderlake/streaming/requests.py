"""A stateless stream of request lines: parse, dispatch, answer.

The same projection runs over a batch of lines and over a stream.  Answers to
calls of the analytical tools are tables, so a call is routed: ``foreachBatch`` can
join the routed rows with the operators' results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corpora

# Error codes of the protocol.
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602

SERVER, VERSION = "cinderlake", "0.3.0"
_TEXT, _TEXTS, _NUMBER = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer"}
_ECOSYSTEM = {"type": "string", "enum": [e[0] for e in corpora.ECOSYSTEMS]}

# Names of the tools and of their arguments, and which arguments a call must have.
TOOLS = {
    "verify": ("Verdicts on packages before they are installed.", {"packages": _TEXTS, "ecosystem": _ECOSYSTEM}, ["packages"]),
    "warden": ("Findings in a tool manifest, given as text or by path.", {"manifest": _TEXT, "path": _TEXT}, []),
    "inspect": ("One verdict on a tool server, by package or install command.", {"server": _TEXT}, ["server"]),
    "verify_lockfile": ("Verdicts on all pins of a lockfile, and entries off the registry or without a hash.", {"path": _TEXT}, ["path"]),
    "provenance": ("Whether published packages carry attestations, which aren't verified.", {"packages": _TEXTS, "ecosystem": _ECOSYSTEM}, ["packages"]),
    "audit": ("Servers, secrets, hooks, settings and instruction files of the agent surface.", {}, []),
    "foresee": ("Names that a model may make up around a project's dependencies, and who registered them.", {"dir": _TEXT, "limit": _NUMBER}, []),
    "skillscan": ("Findings in skills, commands and their scripts.", {"dir": _TEXT}, []),
    "memcheck": ("Findings in stored memories.", {"dir": _TEXT}, []),
    "cardcheck": ("Findings in an agent card, known by its target or given as text.", {"target": _TEXT, "card": _TEXT}, []),
    "lock": ("Records the tools of manifests in a lock.", {"paths": _TEXTS, "lock": _TEXT}, ["paths"]),
    "drift": ("Changes of manifests against a lock.", {"paths": _TEXTS, "lock": _TEXT}, ["paths"]),
    "scan_content": ("Findings in untrusted text.", {"content": _TEXT}, ["content"]),
    "scan_repo": ("Needs another product's program; this server has no handler for it.", {"path": _TEXT}, []),
}


def catalogue() -> str:
    """What ``tools/list`` answers, as JSON."""
    tools = []
    for name, (what, arguments, required) in TOOLS.items():
        schema = {"type": "object", "properties": arguments} | ({"required": required} if required else {})
        tools.append({"name": name, "description": what, "inputSchema": schema})
    return json.dumps({"tools": tools})


def negotiated(requested: Column) -> Column:
    return F.when(requested.isin(corpora.PROTOCOLS), requested).otherwise(corpora.PROTOCOLS[0])


def respond(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds ``id`` (JSON), ``method, tool, outcome, code, protocol``; lines without an answer have outcome ``none``."""
    text = F.trim(F.col(line), F.lit(" \t\r\n"))
    v = F.try_parse_json(text)
    at = lambda p, t="string": F.try_variant_get(v, p, t)
    is_text = lambda p: F.coalesce(F.schema_of_variant(at(p, "variant")) == "STRING", F.lit(False))
    df = lines.where(text != "").withColumn("_ok", v.isNotNull())
    df = df.withColumn("id", F.to_json(at("$.id", "variant"))).withColumn("_has_id", at("$.id", "variant").isNotNull())
    df = df.withColumn("method", F.when(is_text("$.method"), at("$.method"))).withColumn("tool", F.when(is_text("$.params.name"), at("$.params.name")))
    method, call = F.col("method"), F.col("method") == "tools/call"
    known = F.coalesce(F.col("tool").isin(list(TOOLS)), F.lit(False))
    outcome = (
        F.when(~F.col("_ok"), "error").when(method.isNull() & F.col("_has_id"), "error").when(~F.col("_has_id"), "none")
        .when(method.isin("initialize", "ping", "tools/list"), "result").when(call & known, "routed").otherwise("error")
    )
    code = (
        F.when(~F.col("_ok"), PARSE_ERROR).when(method.isNull() & F.col("_has_id"), INVALID_REQUEST).when(~F.col("_has_id"), None)
        .when(call & ~known, BAD_PARAMS).when(~method.isin("initialize", "ping", "tools/list", "tools/call"), NO_METHOD)
    )
    protocol = F.when((method == "initialize") & F.col("_has_id"), negotiated(at("$.params.protocolVersion")))
    return df.withColumns({"outcome": outcome, "code": code, "protocol": protocol}).drop("_ok", "_has_id")


def answers(responded: DataFrame) -> DataFrame:
    """The answer lines: notifications and routed calls have none here."""
    c = F.col
    message = F.when(c("code") == PARSE_ERROR, "parse error").when(c("code") == INVALID_REQUEST, "invalid request").when(c("code") == BAD_PARAMS, "unknown tool").otherwise("unknown method")
    error = F.struct(c("code").alias("code"), message.alias("message"))
    greeting = F.to_json(F.struct(c("protocol").alias("protocolVersion"), F.parse_json(F.lit('{"tools":{}}')).alias("capabilities"), F.struct(F.lit(SERVER).alias("name"), F.lit(VERSION).alias("version")).alias("serverInfo")))
    result = F.when(c("method") == "initialize", greeting).when(c("method") == "tools/list", F.lit(catalogue())).otherwise("{}")
    head = F.struct(
        F.lit("2.0").alias("jsonrpc"), F.parse_json(F.coalesce("id", F.lit("null"))).alias("id"), F.when(c("outcome") == "error", error).alias("error"),
        F.when(c("outcome") == "result", F.parse_json(result)).alias("result"),
    )
    return responded.where(c("outcome").isin("error", "result")).select(F.to_json(head).alias("value"))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Request lines of files as they arrive."""
    return spark.readStream.format("text").load(folder)


def serve(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True):
    """Answer lines of ``folder`` in ``out``; restarts go on from the checkpoint."""
    writer = answers(respond(read_stream(spark, folder))).writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
