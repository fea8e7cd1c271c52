"""Files of an agent surface and of projects, read as whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corpora

# Where agents keep configurations, instructions and memories.
PROJECT_CONFIGS = [".mcp.json", ".vscode/mcp.json", ".cursor/mcp.json", ".claude/settings.json", ".claude/settings.local.json"]
HOME_CONFIGS = [
    ".claude.json", ".claude/settings.json", ".cursor/mcp.json", ".codeium/windsurf/mcp_config.json",
    "Library/Application Support/Claude/claude_desktop_config.json", ".config/Claude/claude_desktop_config.json",
]
INSTRUCTIONS = ["CLAUDE.md", "AGENTS.md", ".clinerules", ".windsurfrules", ".cursorrules", ".github/copilot-instructions.md"]
INSTRUCTION_PATTERNS = [r"(^|/)\.cursor/rules/[^/]+\.mdc$", r"(^|/)\.claude/skills/[^/]+/SKILL\.md$"]


def whole_texts(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """``path, file_name, text`` of each file below the paths; one row per file."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(paths)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def ends_with_any(path: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (path == n) | F.endswith(path, F.lit(f"/{n}"))
    return out


def is_config(path: Column) -> Column:
    return ends_with_any(path, PROJECT_CONFIGS + HOME_CONFIGS)


def is_instruction(path: Column) -> Column:
    out = ends_with_any(path, INSTRUCTIONS)
    for p in INSTRUCTION_PATTERNS:
        out = out | path.rlike(p)
    return out


def is_memory(path: Column) -> Column:
    """Memory files by name, and Markdown or JSON lines in a memory folder."""
    return path.rlike(r"(?i)(^|/)memory\.(md|jsonl)$") | path.rlike(r"(^|/)(memory|memories|\.memory)/[^/]+\.(md|jsonl)$") | ends_with_any(path, ["CLAUDE.md", "AGENTS.md"])


def first_manifest(files: DataFrame, directory: str = "directory") -> DataFrame:
    """The first of the known manifest names that a directory has."""
    place = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(corpora.MANIFEST_FILES))):
        place = F.when(F.col("file_name") == n, i).otherwise(place)
    known = files.withColumn("_place", place).where("_place is not null")
    best = known.groupBy(directory).agg(F.min_by("file_name", "_place").alias("file_name"))
    return known.join(best, [directory, "file_name"], "left_semi").drop("_place")


def literal_text(spark: SparkSession, text: str, label: str = "-") -> DataFrame:
    """A text given by hand, as a table of one row."""
    return spark.createDataFrame([(label, text)], "label string, text string")
