"""Dependency manifests and lockfiles: extraction, and findings on locked entries."""

from __future__ import annotations

import tomllib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import corpora, jsontree, names
from ..functions import text as T
from . import lines, text_rules

PEP508 = "^([A-Za-z0-9._-]*)"


# Manifests

def ecosystem_of(file_name: Column) -> Column:
    low = F.lower(file_name)
    return (
        F.when(low == "package.json", "npm")
        .when(low.rlike(r"^requirements.*\.txt$") | (low == "pyproject.toml"), "pypi")
        .when(low == "cargo.toml", "crates")
    )


def npm_registry_name(name: Column, spec: Column) -> Column:
    """What a dependency installs from the registry, or null if it comes from elsewhere."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    alias = names.descriptor_name(F.trim(F.substr(s, F.lit(5))))
    elsewhere = F.contains(s, F.lit("/"))
    for p in corpora.NON_REGISTRY:
        elsewhere = elsewhere | F.startswith(s, F.lit(p))
    return F.when(F.startswith(s, F.lit("npm:")), alias).when(~elsewhere, name)


def package_json(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    blocks = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
    parsed = F.from_json(F.col(text), "STRUCT<" + ", ".join(f"{b}: MAP<STRING, STRING>" for b in blocks) + ">")
    entries = F.flatten(F.array_compact(F.array(*[F.map_entries(F.col("_p").getField(b)) for b in blocks])))
    rows = files.withColumn("_p", parsed).select(key, F.explode(entries).alias("e"))
    return rows.select(key, npm_registry_name(F.col("e.key"), F.col("e.value")).alias("name")).where("name is not null").distinct()


def requirement_lines(files: DataFrame, key: str, text: str, joined: bool = False) -> DataFrame:
    body = F.col(text)
    if joined:
        body = F.replace(body, F.lit("\\\n"), F.lit(" "))
    line = F.regexp_replace(F.col("line"), "^#.*$| #.*$", "")
    rows = files.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "line")).select(key, "pos", T.trimmed(line).alias("line"))
    return rows.where((F.col("line") != "") & ~F.startswith("line", F.lit("-")) & ~F.contains("line", F.lit("://")))


def requirements(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    rows = requirement_lines(files, key, text)
    return rows.select(key, F.regexp_extract("line", PEP508, 1).alias("name")).where("name <> ''").distinct()


def _pep508(spec) -> str:
    import re

    return re.match(PEP508, spec.strip())[1] if isinstance(spec, str) else ""


def _tables(*path):
    """Follow keys through tables, or an empty table."""
    value = path[0]
    for k in path[1:]:
        value = value.get(k) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


def _pyproject(t: dict) -> set[str]:
    project = _tables(t, "project")
    lists = [project.get("dependencies"), *_tables(project, "optional-dependencies").values()]
    found = {_pep508(s) for x in lists if isinstance(x, list) for s in x}
    poetry = _tables(t, "tool", "poetry")
    groups = [_tables(poetry, "dependencies"), _tables(poetry, "dev-dependencies")]
    groups += [_tables(g, "dependencies") for g in _tables(poetry, "group").values()]
    found |= {k for g in groups for k, v in g.items() if k != "python" and not (isinstance(v, dict) and {"path", "git", "url"} & v.keys())}
    return found - {""}


def _cargo(t: dict) -> set[str]:
    out = set()
    for part in [t, *_tables(t, "target").values()]:
        for section in ("dependencies", "dev-dependencies", "build-dependencies"):
            for k, v in _tables(part, section).items():
                v = v if isinstance(v, dict) else {}
                if not {"path", "git"} & v.keys():
                    out.add(v["package"] if isinstance(v.get("package"), str) else k)
    return out


def _cargo_lock(t: dict) -> list[tuple]:
    rows = [p for p in t.get("package", []) if isinstance(p, dict) and isinstance(p.get("source"), str)]
    return [(p.get("name"), p.get("version") or None, p["source"], bool(p.get("checksum"))) for p in rows]


def _poetry_lock(t: dict) -> list[tuple]:
    files = _tables(t, "metadata", "files")
    out = []
    for p in t.get("package", []):
        if _tables(p, "source").get("type") not in ("directory", "file", "git", "url"):
            out.append((p.get("name"), p.get("version") or None, None, bool(files.get(p.get("name")) or p.get("files"))))
    return out


def _toml(texts: pd.Series, f) -> pd.Series:
    """Small helper: TOML has no reader in Spark.  Null for text that isn't TOML."""
    out = []
    for t in texts:
        try:
            out.append(f(tomllib.loads(t)))
        except (tomllib.TOMLDecodeError, TypeError, AttributeError):
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(jsontree.TEXTS)
def _pyproject_names(texts: pd.Series) -> pd.Series:
    return _toml(texts, lambda t: sorted(_pyproject(t)))


@F.pandas_udf(jsontree.TEXTS)
def _cargo_names(texts: pd.Series) -> pd.Series:
    return _toml(texts, lambda t: sorted(_cargo(t)))


LOCKED = jsontree.rows_type(name=jsontree.TEXT, version=jsontree.TEXT, resolved=jsontree.TEXT, has_integrity=types.BooleanType())


def _entries(rows) -> list[dict]:
    return [dict(zip(("name", "version", "resolved", "has_integrity"), r)) for r in rows]


@F.pandas_udf(LOCKED)
def _cargo_entries(texts: pd.Series) -> pd.Series:
    return _toml(texts, lambda t: _entries(_cargo_lock(t)))


@F.pandas_udf(LOCKED)
def _poetry_entries(texts: pd.Series) -> pd.Series:
    return _toml(texts, lambda t: _entries(_poetry_lock(t)))


def manifest_names(files: DataFrame, key: str, file_name: str = "file_name", text: str = "text") -> DataFrame:
    """``key, ecosystem, name`` of every dependency, by the kind of file."""
    low = F.lower(file_name)
    keep = files.withColumn("ecosystem", ecosystem_of(F.col(file_name)))
    toml = keep.where(low.isin("pyproject.toml", "cargo.toml"))
    parts = [
        package_json(keep.where(low == "package.json"), key, text).withColumn("ecosystem", F.lit("npm")),
        requirements(keep.where(low.rlike(r"^requirements.*\.txt$")), key, text).withColumn("ecosystem", F.lit("pypi")),
        toml.where(low == "pyproject.toml").select(key, "ecosystem", F.explode(_pyproject_names(F.col(text))).alias("name")),
        toml.where(low == "cargo.toml").select(key, "ecosystem", F.explode(_cargo_names(F.col(text))).alias("name")),
    ]
    out = parts[0].select(key, "ecosystem", "name")
    for p in parts[1:]:
        out = out.unionByName(p.select(key, "ecosystem", "name"))
    return out


# Lockfiles: every reader returns key, ord, name, version, resolved, has_integrity

def _blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def package_lock(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The ``packages`` map if there is one, else ``dependencies`` at any depth."""
    v3 = F.from_json(F.col(text), "packages MAP<STRING, STRUCT<name: STRING, version: STRING, resolved: STRING, integrity: STRING>>")["packages"]
    rows = files.withColumn("_v3", v3)
    new = rows.where("_v3 is not null").select(key, F.posexplode(F.array_sort(F.map_entries("_v3"), lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))).alias("ord", "e"))
    tail = F.regexp_replace(F.col("e.key"), r"^.*node_modules/", "")
    new = new.where("e.key <> ''").select(
        key, "ord", F.coalesce(F.col("e.value.name"), tail).alias("name"), _blank_null(F.col("e.value.version")).alias("version"),
        _blank_null(F.col("e.value.resolved")).alias("resolved"), (F.coalesce(F.col("e.value.integrity"), F.lit("")) != "").alias("has_integrity"),
    )
    old = rows.where("_v3 is null").select(key, F.posexplode(jsontree.locked_packages(F.col(text))).alias("ord", "e")).select(
        key, "ord", F.col("e.name").alias("name"), _blank_null(F.col("e.version")).alias("version"),
        _blank_null(F.col("e.resolved")).alias("resolved"), (F.coalesce("e.integrity", F.lit("")) != "").alias("has_integrity"),
    )
    return new.unionByName(old)


def _lines(files: DataFrame, key: str, text: str) -> DataFrame:
    rows = files.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))
    rows = rows.select(key, "pos", F.regexp_replace("line", r"[ \t]+$", "").alias("line"))
    return rows.where(~F.col("line").rlike(r"^[ \t]*(#|$)"))


def _blocks(rows: DataFrame, key: str, head: Column) -> DataFrame:
    """The number of the block that a line belongs to: heads count up, lines before any are in block 0."""
    return lines.running(rows.withColumn("head", head), key, sums={"ord": F.col("head").cast("int")}).where("ord > 0")


#: Bytes of a file whose blocks are cut in its row; the lines of a longer one are dealt over tasks.
SHORT = 1 << 20


def _by_length(files: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    size = F.octet_length(F.col(text))
    return files.where(size <= SHORT), files.where(size > SHORT)


def _line_array(text: str) -> Column:
    """Of a short file, what ``_lines`` gives of any."""
    every = F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.regexp_replace(x, r"[ \t]+$", ""))
    return F.filter(every, lambda x: ~x.rlike(r"^[ \t]*(#|$)"))


def _cut(df: DataFrame, array: str, head: Callable[[Column], Column]) -> tuple[DataFrame, Column]:
    """An array of lines in pieces that begin at heads; what comes before the first is left out."""
    df = T.once(df, _starts=F.array_compact(F.transform(array, lambda x, i: F.when(head(x), i))))
    end = lambda j: F.coalesce(F.get("_starts", j + 1), F.size(array))
    return df, F.transform("_starts", lambda s, j: F.slice(array, s + 1, end(j) - s))


def _cut_blocks(df: DataFrame, key: str, array: str, head: Callable[[Column], Column]) -> DataFrame:
    """``key, ord``, a block's ``line`` (its head) and ``body``, the trimmed lines below it."""
    df, pieces = _cut(df, array, head)
    rows = df.select(key, F.posexplode(pieces).alias("ord", "rows"))
    return T.once(rows.withColumn("ord", (F.col("ord") + 1).cast("long")), line=F.get("rows", F.lit(0)), body=F.transform(F.slice("rows", F.lit(2), F.size("rows") - 1), lambda x: F.trim(x)))


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("pos")))


def _last_of(body: Column, value: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.array_compact(F.transform(body, value)), F.lit(-1))


def _yarn_head(line: Column) -> Column:
    return ~F.startswith(line, F.lit(" ")) & F.endswith(line, F.lit(":"))


def _yarn_name(line: Column) -> Column:
    return names.descriptor_name(_unquoted(F.substring_index(F.regexp_replace(line, ":+$", ""), ",", 1)))


def _yarn_value(body: Column, k: str) -> Column:
    return F.when(body.rlike(f"^{k}[ \t]"), _unquoted(F.substr(body, F.lit(len(k) + 1))))


def _yarn_integrity(body: Column) -> Column:
    return body.rlike("^integrity[ \t]")


def _short_yarn(files: DataFrame, key: str, text: str) -> DataFrame:
    rows = _cut_blocks(T.once(files.select(key, text), _lines=_line_array(text)), key, "_lines", _yarn_head)
    value = lambda k: _last_of(F.col("body"), lambda x: _yarn_value(x, k))
    return rows.select(
        key, "ord", _yarn_name(F.col("line")).alias("name"), value("version").alias("version"), value("resolved").alias("resolved"), F.exists("body", _yarn_integrity).alias("has_integrity")
    )


def _long_yarn(files: DataFrame, key: str, text: str) -> DataFrame:
    line = F.col("line")
    rows = _blocks(_lines(files, key, text), key, _yarn_head(line))
    body = F.trim(line)
    value = lambda k: F.when(~F.col("head"), _yarn_value(body, k))
    return rows.groupBy(key, "ord").agg(
        F.first(F.when(F.col("head"), _yarn_name(line)), ignorenulls=True).alias("name"), _last(value("version")).alias("version"),
        _last(value("resolved")).alias("resolved"), F.bool_or(~F.col("head") & _yarn_integrity(body)).alias("has_integrity"),
    )


def yarn_lock(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    short, long_ = _by_length(files, text)
    return _short_yarn(short, key, text).unionByName(_long_yarn(long_, key, text)).where("name is not null")


def _pnpm_top(line: Column) -> Column:
    return ~F.startswith(line, F.lit(" "))


def _pnpm_head(line: Column) -> Column:
    return line.rlike("^  [^ ]") & F.endswith(line, F.lit(":"))


def _pnpm_key(line: Column) -> Column:
    return F.regexp_replace(_unquoted(F.regexp_replace(F.regexp_replace(F.trim(line), ":+$", ""), "^/+", "")), r"\(.*$", "")


def _pnpm_tarball(body: Column) -> Column:
    inline = F.when(body.rlike(r"^resolution:\s*\{"), body)
    return F.coalesce(
        _blank_null(_unquoted(F.regexp_extract(inline, r"[{,]\s*tarball:([^,}]*)", 1))), _blank_null(_unquoted(F.regexp_extract(body, "^tarball:(.*)$", 1)))
    )


def _pnpm_integrity(body: Column) -> Column:
    inline = F.when(body.rlike(r"^resolution:\s*\{"), body)
    return F.coalesce(inline.rlike(r"[{,]\s*integrity:\s*[^,}\s]") | body.rlike(r"^integrity:\s*\S"), F.lit(False))


def _short_pnpm(files: DataFrame, key: str, text: str) -> DataFrame:
    df, sections = _cut(T.once(files.select(key, text), _lines=_line_array(text)), "_lines", _pnpm_top)
    inside = F.filter(sections, lambda x: F.regexp_replace(F.get(x, F.lit(0)), ":+$", "") == "packages")
    df = T.once(df, _packages=F.flatten(F.transform(inside, lambda x: F.slice(x, F.lit(2), F.size(x) - 1)))).drop("_starts")
    rows = T.once(_cut_blocks(df, key, "_packages", _pnpm_head), _key=_pnpm_key(F.col("line")))
    return rows.select(
        key, "ord", names.descriptor_name(F.col("_key")).alias("name"), names.descriptor_version(F.col("_key")).alias("version"),
        _last_of(F.col("body"), _pnpm_tarball).alias("resolved"), F.exists("body", _pnpm_integrity).alias("has_integrity"),
    )


def _long_pnpm(files: DataFrame, key: str, text: str) -> DataFrame:
    line = F.col("line")
    top = _pnpm_top(line)
    inside = lines.running(_lines(files, key, text), key, lasts={"section": F.when(top, F.regexp_replace(line, ":+$", ""))})
    rows = _blocks(inside.where((F.col("section") == "packages") & ~top).drop("section"), key, _pnpm_head(line))
    body, head_key = F.trim(line), _pnpm_key(line)
    return rows.groupBy(key, "ord").agg(
        F.first(F.when(F.col("head"), names.descriptor_name(head_key)), ignorenulls=True).alias("name"),
        F.first(F.when(F.col("head"), names.descriptor_version(head_key)), ignorenulls=True).alias("version"),
        _last(F.when(~F.col("head"), _pnpm_tarball(body))).alias("resolved"), F.bool_or(~F.col("head") & _pnpm_integrity(body)).alias("has_integrity"),
    )


def pnpm_lock(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The ``packages:`` section, keys at an indent of two."""
    short, long_ = _by_length(files, text)
    return _short_pnpm(short, key, text).unionByName(_long_pnpm(long_, key, text)).where("name is not null")


def hashed_requirements(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    rows = requirement_lines(files, key, text, joined=True).where(F.contains("line", F.lit("==")))
    rest = F.trim(F.regexp_replace(F.substr("line", F.locate("==", F.col("line")) + 2), r"\s+", " "))
    version = _blank_null(F.regexp_replace(F.substring_index(rest, " ", 1), ";+$", ""))
    rows = rows.select(
        key, "pos", F.regexp_extract(F.trim(F.substring_index("line", "==", 1)), PEP508, 1).alias("name"), version.alias("version"),
        F.col("line").rlike("--hash[= ]").alias("has_integrity"),
    ).where("name <> ''")
    out = rows.groupBy(key, "name").agg(F.min_by("version", F.when(F.col("version").isNotNull(), F.col("pos"))).alias("version"), F.bool_or("has_integrity").alias("has_integrity"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("name")) - 1
    return out.select(key, place.alias("ord"), "name", "version", F.lit(None).cast("string").alias("resolved"), "has_integrity")


def toml_lock(files: DataFrame, key: str, kind: str, text: str = "text") -> DataFrame:
    parser = {"cargo": _cargo_entries, "poetry": _poetry_entries}[kind]
    return files.select(key, F.posexplode(parser(F.col(text))).alias("ord", "e")).select(key, "ord", "e.*").where("name is not null")


LOCK_KINDS = {
    "package-lock": (r"^(package-lock|npm-shrinkwrap)\.json$", "npm", package_lock),
    "yarn": (r"^yarn\.lock$", "npm", yarn_lock),
    "pnpm": (r"^pnpm-lock\.yaml$", "npm", pnpm_lock),
    "cargo": (r"^cargo\.lock$", "crates", lambda f, k, t: toml_lock(f, k, "cargo", t)),
    "poetry": (r"^poetry\.lock$", "pypi", lambda f, k, t: toml_lock(f, k, "poetry", t)),
    "requirements": (r"^requirements.*\.txt$", "pypi", hashed_requirements),
}


def read_lockfiles(files: DataFrame, key: str, file_name: str = "file_name", text: str = "text") -> DataFrame:
    """``key, ecosystem, ord, name, version, resolved, has_integrity`` for six formats, by file name."""
    out = None
    for pattern, ecosystem, reader in LOCK_KINDS.values():
        part = reader(files.where(F.lower(file_name).rlike(pattern)), key, text).withColumn("ecosystem", F.lit(ecosystem))
        part = part.select(key, "ecosystem", F.col("ord").cast("int").alias("ord"), "name", "version", "resolved", "has_integrity")
        out = part if out is None else out.unionByName(part)
    return out


def package_refs(locked: DataFrame, key: str) -> DataFrame:
    """The distinct pins of a lockfile."""
    return locked.select(key, "ecosystem", "name", "version").distinct()


def integrity_findings(locked: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that resolve outside the official registries, and entries without a hash."""
    host = names.resolved_host(F.col("resolved"))
    canonical = (F.col("ecosystem") == "crates") & (F.col("resolved") == corpora.CRATES_SOURCE)
    off = host.isNotNull() & ~canonical & ~names.official(host, F.col("ecosystem"))
    rules = [
        F.when(off, text_rules.finding("HIGH", "off-registry-resolved", F.concat(F.lit("resolves from "), host), T.truncated(F.col("resolved"), 120, "…"), 0)),
        F.when(~F.col("has_integrity") & F.col("resolved").isNotNull(), text_rules.finding("MEDIUM", "missing-integrity", "locked without a hash", None, 1)),
    ]
    return text_rules.scan_rules(locked, keys, rules, names.display_name(F.col("name"), F.col("version")))
