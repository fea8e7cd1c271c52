"""The agent surface: configuration trees, skills and stored memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import corpora, hashing, jsontree
from ..functions import text as T
from . import allowlist, lines, text_rules

SECRET_KEY = r"(?i)(token|secret|passwo?r?d|api[_-]?key|access[_-]?key|private[_-]?key|credential)"
SECRET_PREFIX = r"^(sk-|ghp_|gho_|github_pat_|glpat-|xox[abp]-|AKIA|AIza|npm_|pypi-)"
PLACEHOLDER = r"(?i)^(\$\{[^}]*\}|<[^>]*>|\*+|x+|change-?me|example.*|your[-_ ].*|todo)$"


# Memory

def memory_records(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, record, text``: each solid line of a .jsonl file; elsewhere parts that begin at ``# ``, ``## `` or ``- ``.

    Another file without a solid line is one record as a whole.  A file's lines are spread over tasks.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "")
    every = files.select(F.col(path).alias("path"), F.posexplode(F.split(body, r"\r?\n")).alias("pos", "line"))
    solid, jsonl = F.col("line").rlike(r"[^ \t\r]"), F.endswith(F.lower(F.col("path")), F.lit(".jsonl"))
    # Each solid line of a .jsonl file is a record.
    single = lines.running(every.where(jsonl & solid), "path", sums={"record": F.lit(1)}).select("path", F.col("record").cast("int").alias("record"), F.col("line").alias("text"))
    # Elsewhere a record begins at a mark that has a solid line before it.
    marked = lines.running(every.where(~jsonl), "path", sums={"solid": solid.cast("int")})
    starts = F.col("line").rlike("^(# |## |- )") & (F.col("solid") > 1)
    parts = lines.running(marked, "path", sums={"block": starts.cast("int")}).groupBy("path", "block").agg(F.max("solid").alias("solid"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    blocks = parts.where("solid > 0").select("path", (F.col("block") + 1).cast("int").alias("record"), F.array_join("rows.line", "\n").alias("text"))
    blank = files.select(F.col(path).alias("path"), F.regexp_replace(body, r"\r\n", "\n").alias("text")).where(~jsonl & ~F.col("text").rlike(r"[^ \t\r\n]"))
    return single.unionByName(blocks).unionByName(blank.select("path", F.lit(1).alias("record"), "text"))


def memcheck(files: DataFrame, path: str = "path", text: str = "text", fingerprints: DataFrame | None = None) -> DataFrame:
    """Findings of every record.  Its label is its number where a file has several, else the path.

    ``fingerprints``: ``kind, fingerprint``; a file that is allowed as ``memory`` reports only that.
    """
    if fingerprints is not None:
        known, rest = allowlist.split_trusted(files.withColumn("fingerprint", hashing.fnv1a_hex(F.coalesce(text, F.lit("")))), fingerprints, "memory")
        marks = allowlist.trusted_marker(known.select(F.col(path).alias("path"), F.lit(None).cast("int").alias("record")), ["path", "record"], F.col("path"))
        return memcheck(rest, path, text).unionByName(marks)
    records = memory_records(files, path, text)
    n = F.count("*").over(Window.partitionBy("path"))
    records = records.withColumn("label", F.when(n > 1, F.concat(F.lit("record "), F.col("record"))).otherwise(F.col("path")))
    records = text_rules.with_findings(records, extra=text_rules.memory_rules(F.col("text")))
    return text_rules.rows_of(records, ["path", "record"], F.col("label"))


def memory_totals(files: DataFrame) -> DataFrame:
    """``path, files, records`` of each memory file."""
    records = memory_records(files).groupBy("path").agg(F.count("*").alias("records"))
    return files.select("path").distinct().join(records, "path", "left").select("path", F.lit(1).alias("files"), F.coalesce("records", F.lit(0)).alias("records"))


# Skills

def skill_files(paths: DataFrame, path: str = "path", depth: int = 6) -> DataFrame:
    """Kind of each file in a skill tree: skill, script or other; nothing below ``depth``."""
    p = F.col(path)
    rest = F.regexp_extract(p, r"\.claude/skills/(.+)$", 1)
    kind = (
        F.when(rest.rlike(r"^[^/]+/SKILL\.md$"), "skill")
        .when(rest.rlike(rf"\.({'|'.join(corpora.SCRIPT_EXTENSIONS)})$"), "script")
        .when(p.rlike(r"\.claude/(commands|agents)/[^/]+\.md$"), "command")
        .otherwise("other")
    )
    levels = F.when(rest == "", 0).otherwise(F.size(F.split(rest, "/")) - 2)
    return paths.withColumn("kind", kind).where(levels <= depth)


def skill_fingerprints(files: DataFrame) -> DataFrame:
    """``skill, fingerprint`` of whole trees.  FNV-1a runs over a tree in order, as a fold over the sorted files of a partition."""
    rows = files.select("skill", F.coalesce("path", F.lit("")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    kind = files.schema["skill"].dataType.simpleString()
    ordered = rows.repartition("skill").sortWithinPartitions("skill", "path", "content")
    return ordered.mapInArrow(hashing.tree_fingerprints, f"tree {kind}, fingerprint string").withColumnRenamed("tree", "skill")


def skillscan(files: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """``files``: ``skill, path, kind, text``.  Findings of front matter, text and scripts.

    ``fingerprints``: ``kind, fingerprint``; a tree that is allowed as ``skill`` reports only that.
    """
    if fingerprints is not None:
        known, _ = allowlist.split_trusted(skill_fingerprints(files), fingerprints, "skill")
        marks = allowlist.trusted_marker(known.select("skill", F.lit(None).cast("string").alias("path")), ["skill", "path"], F.col("skill").cast("string"))
        return skillscan(files.join(known.select("skill"), "skill", "left_anti")).unionByName(marks)
    docs = files.where(F.col("kind").isin("skill", "command"))
    front = T.frontmatter(F.col("text"))
    docs = docs.withColumn("_front", front).withColumn("label", F.when(F.col("kind") == "skill", "SKILL.md").otherwise("body"))
    docs = text_rules.with_findings(docs, extra=text_rules.frontmatter_rules(F.col("_front")))
    scripts = files.where("kind = 'script'")
    out = text_rules.rows_of(docs, ["skill", "path"], F.col("label"))
    return out.unionByName(text_rules.scan_rules(scripts, ["skill", "path"], text_rules.script_rules(F.col("text")), F.col("path")))


# Configuration trees

def config_nodes(configs: DataFrame, path: str = "source", text: str = "text") -> DataFrame:
    """Every object member of every configuration that is JSON; others are skipped."""
    return configs.select(F.col(path).alias("source"), F.inline(jsontree.nodes(F.col(text))))


def values_for_key(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.where(F.col("key") == key)


def is_network(command: Column) -> Column:
    return T.any_of(F.lower(command), corpora.NETWORK)


def hook_commands(nodes: DataFrame) -> DataFrame:
    """Command strings below ``hooks``, and whether they use the network."""
    hooks = nodes.where((F.col("key") == "command") & (F.col("kind") == "string") & F.array_contains("under", "hooks"))
    return hooks.select("source", F.col("value").alias("command"), is_network(F.col("value")).alias("network"))


#: Keys that settings_findings looks at.
SETTINGS_KEYS = list(dict.fromkeys([*corpora.AUTO_APPROVE_KEYS, *corpora.MODE_KEYS, "command", "args"]))


def settings_findings(nodes: DataFrame) -> DataFrame:
    """Settings that widen what an agent does by itself: ``source, kind, detail, severity``."""
    key, kind, value = F.col("key"), F.col("kind"), F.col("value")
    tokens = F.when(kind == "string", F.split(F.trim(value), r"\s+")).when(kind == "array", F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull()))
    flags = F.array_intersect(tokens, F.array(*[F.lit(f) for f in corpora.BYPASS_FLAGS]))
    low = F.lower(value)
    rules = {
        "auto-approve": (key.isin(corpora.AUTO_APPROVE_KEYS) & (((kind == "boolean") & (value == "true")) | ((kind == "array") & (F.col("size") > 0))), key),
        "permission-bypass": (key.isin(corpora.MODE_KEYS) & (kind == "string") & value.isin(corpora.BYPASS_MODES), F.concat_ws(": ", key, value)),
        "fetch-and-exec": ((key == "command") & (kind == "string") & is_network(value) & T.any_of(low, corpora.EXEC_SINKS), T.truncated(value, 80, "...")),
        "bypass-flag": (key.isin("command", "args") & (F.size(F.coalesce(flags, F.array())) > 0), F.array_join(flags, " ")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), d.alias("detail"), F.lit("HIGH").alias("severity"))) for k, (c, d) in rules.items()]))
    return nodes.select("source", F.inline(found)).distinct()


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    n = F.size(chars)
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: acc + share(x) * F.log2(share(x)))


def secret_kind(key: Column, value: Column, least_entropy: float = 3.0) -> Column:
    """``prefixed``, ``keyed`` or null: a known key prefix, or a telling name with a value of high entropy."""
    v = F.trim(value)
    long_ = (F.length(v) >= 16) & (F.length(v) <= 512) & ~v.rlike(PLACEHOLDER) & ~v.rlike(r"\s")
    return F.when(long_ & v.rlike(SECRET_PREFIX), "prefixed").when(long_ & key.rlike(SECRET_KEY), F.when(entropy(v) >= least_entropy, "keyed"))


def redacted(value: Column) -> Column:
    return F.concat(F.substr(F.trim(value), F.lit(1), F.lit(4)), F.lit("…"))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def audit(configs: DataFrame, instructions: DataFrame) -> dict[str, DataFrame]:
    """``configs``: ``ord, source, text``; ``instructions``: ``source, text``.  The relations of an audit."""
    own = configs.withColumn("text", jsontree.may_hold(["mcpServers"], F.col("text"))).where("text is not null")
    parsed = own.select("ord", "source", F.posexplode(jsontree.tool_servers(F.col("text"))).alias("place", "server")).select("ord", "source", "place", "server.*")
    servers = first_seen(parsed.where("spec is not null"), ["spec"], ["ord", "place"]).select("source", "name", "spec")
    pairs = parsed.select("ord", "source", F.col("name").alias("server"), F.inline("pairs"))
    pairs = pairs.withColumn("kind", secret_kind(F.col("key"), F.col("value"))).where("kind is not null")
    secrets = first_seen(pairs, ["source", "server", "key"], ["ord", "value"]).select("source", "server", "key", "kind", redacted(F.col("value")).alias("redacted"))
    read = lambda keys: configs.where(jsontree.may_hold(keys, F.col("text")).isNotNull()).select("source", F.inline(jsontree.nodes_of(keys, F.col("text"))))
    return {
        "servers": servers,
        "secrets": secrets,
        "hooks": hook_commands(read(["command"])).distinct(),
        "settings": settings_findings(read(SETTINGS_KEYS)),
        "texts": text_rules.scan_text(instructions.withColumn("label", F.col("source")), ["source"]),
    }


def snapshot(parts: dict[str, DataFrame]) -> DataFrame:
    """The audit as a long table ``kind, value`` that can be compared later."""
    rows = [
        parts["servers"].select(F.lit("servers").alias("kind"), F.col("spec").alias("value")),
        parts["settings"].select(F.lit("dangerous").alias("kind"), F.concat_ws(": ", "kind", "detail").alias("value")),
        parts["hooks"].where("network").select(F.lit("network_hooks").alias("kind"), F.col("command").alias("value")),
        parts["secrets"].select(F.lit("secret_keys").alias("kind"), F.concat_ws("/", "server", "key").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


def totals(parts: dict[str, DataFrame], flagged: DataFrame | None = None) -> DataFrame:
    """One row of an audit's totals.  ``flagged``: the ``spec`` of each server whose package report is flagged."""
    number = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    counted = {
        "servers": parts["servers"], "flagged": parts["servers"].limit(0) if flagged is None else parts["servers"].join(flagged.select("spec").distinct(), "spec", "left_semi"),
        "instruction_findings": parts["texts"], "network_hooks": parts["hooks"].where("network"), "secrets": parts["secrets"], "settings": parts["settings"],
    }
    out = None
    for name, df in counted.items():
        out = number(df, name) if out is None else out.unionByName(number(df, name))
    return out.agg(*[F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in counted])
