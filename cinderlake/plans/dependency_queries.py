"""Queries on dependency manifests, lockfiles and URLs.

File texts are made of table columns by one SQL expression for both engines; the
statements give the fields that a reader has to find in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import dependencies as D
from .common import dealt, table

N = "replace(lower(p_name), ' ', '-')"
NL = "chr(10)"
V = "CAST(p_size AS VARCHAR(9))"


def _files(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.expr(text).alias("text"))


PACKAGE_JSON = f"""concat('{{"name":"x","dependencies":{{"', {N}, '":"^', {V}, '","local":"file:../x","gh":"owner/repo"}},"devDependencies":{{"al', {V}, '":"npm:@scope/target@^1","bare":"npm:plain"}},"peerDependencies":{{"', {N}, '":"*","g":"git+ssh://x"}}}}')"""
REQUIREMENTS = f"""concat('# head', {NL}, {N}, '[extra]>=1 ; python_version<"3" # note', {NL}, '-r other.txt', {NL}, 'git+https://x.example/y', {NL}, 'Pinned_', {V}, '==1.0', {NL}, '   ', {NL}, 'a#b', {NL}, '--hash=sha256:x')"""
PYPROJECT = f"""concat('[project]', {NL}, 'dependencies = ["', {N}, '>=1", "b"]', {NL}, '[project.optional-dependencies]', {NL}, 't = ["opt', {V}, '"]', {NL}, '[tool.poetry.dependencies]', {NL}, 'python = "^3"', {NL}, 'poe = "1"', {NL}, 'loc = {{path = "x"}}', {NL}, '[tool.poetry.group.dev.dependencies]', {NL}, 'grp = {{version = "1"}}')"""
CARGO = f"""concat('[dependencies]', {NL}, {N}, ' = "1"', {NL}, 'loc = {{path = "x"}}', {NL}, 'ren = {{package = "real', {V}, '", version = "1"}}', {NL}, '[target.x.build-dependencies]', {NL}, 'bld = "1"')"""
YARN = f"""concat('# yarn lockfile v1', {NL}, {NL}, '"@s/', {N}, '@^1", "@s/', {N}, '@^2":', {NL}, '  version "1.', {V}, '"', {NL}, '  resolved "https://registry.yarnpkg.com/x"', {NL}, '  integrity sha512-x', {NL}, {NL}, 'plain@*:', {NL}, '  version "2"', {NL}, '  dependencies:', {NL}, '    y "1"')"""
PNPM = f"""concat('lockfileVersion: 6', {NL}, 'packages:', {NL}, '  /', {N}, '@1.', {V}, '(peer@2):', {NL}, '    resolution: {{integrity: sha512-x, tarball: https://t.example/x}}', {NL}, '    dev: true', {NL}, {NL}, "  '@s/b@2':", {NL}, '    resolution:', {NL}, '      integrity: sha512-y', {NL}, '  c@3:', {NL}, '    resolution: {{integrity: }}', {NL}, 'other:', {NL}, '  /z@1:')"""
LOCK3 = f"""concat('{{"packages":{{"":{{"name":"root"}},"node_modules/a/node_modules/', {N}, '":{{"version":"1.', {V}, '","resolved":"https://r/x","integrity":"s"}},"node_modules/z":{{"name":"real","version":"","link":true}}}}}}')"""
LOCK1 = f"""concat('{{"dependencies":{{"', {N}, '":{{"version":"1","resolved":"https://r/x","integrity":"s","dependencies":{{"inner":{{"version":"', {V}, '"}}}}}}}}}}')"""
CARGO_LOCK = f"""concat('[[package]]', {NL}, 'name = "', {N}, '"', {NL}, 'version = "1.', {V}, '"', {NL}, 'source = "registry+https://github.com/rust-lang/crates.io-index"', {NL}, 'checksum = "abc"', {NL}, '[[package]]', {NL}, 'name = "own"', {NL}, 'version = "1"')"""
POETRY = f"""concat('[[package]]', {NL}, 'name = "', {N}, '"', {NL}, 'version = "', {V}, '"', {NL}, '[[package]]', {NL}, 'name = "bare"', {NL}, 'version = "1"', {NL}, '[[package]]', {NL}, 'name = "g"', {NL}, 'version = "1"', {NL}, '[package.source]', {NL}, 'type = "git"', {NL}, '[metadata.files]', {NL}, '"', {N}, '" = [{{file = "f", hash = "h"}}]')"""
HASHED = f"""concat({N}, '==1.', {V}, ' ', chr(92), {NL}, '    --hash=sha256:a', {NL}, 'dup==', {NL}, 'dup==2; x', {NL}, 'dup==3 --hash=b', {NL}, 'range>=1', {NL}, 'm==3.0;python_version<"3"')"""


def _names(reader):
    def query(text: str):
        return lambda spark, sf_dir: reader(_files(spark, sf_dir, text))

    return query


def _manifest(file_name: str, text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _files(spark, sf_dir, text).withColumn("file_name", F.lit(file_name))
        return D.manifest_names(files, "p_partkey").select("p_partkey", "ecosystem", "name")

    return query


def _lock(file_name: str, text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _files(spark, sf_dir, text).withColumn("file_name", F.lit(file_name))
        return D.read_lockfiles(files, "p_partkey").select("p_partkey", "ecosystem", "name", "version", "resolved", "has_integrity")

    return query


def _manifest_sql(ecosystem: str, *found: str) -> str:
    return " UNION ".join(f"SELECT p_partkey, '{ecosystem}' AS ecosystem, {x} AS name FROM part" for x in found)


def _lock_sql(ecosystem: str, *rows: tuple[str, str, str, str]) -> str:
    cols = "SELECT p_partkey, '{}' AS ecosystem, {} AS name, CAST({} AS VARCHAR) AS version, CAST({} AS VARCHAR) AS resolved, {} AS has_integrity FROM part"
    return " UNION ALL ".join(cols.format(ecosystem, *r) for r in rows)


RESOLVED = """CASE page_id % 6 WHEN 0 THEN 'https://registry.npmjs.org/x/-/x.tgz' WHEN 1 THEN 'sparse+https://user@INDEX.crates.io:443/y' WHEN 2 THEN 'registry+https://github.com/rust-lang/crates.io-index'
 WHEN 3 THEN 'git+https://github.com/a/b' WHEN 4 THEN NULL ELSE url END"""
PAGE_ECO = "CASE page_id % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'crates' END"


def _locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.expr(PAGE_ECO).alias("ecosystem"), F.concat(F.lit("p"), "page_id").alias("name"), F.lit("1").alias("version"), F.expr(RESOLVED).alias("resolved"), F.expr("page_id % 2 = 0").alias("has_integrity")
    )


def lock_findings(category: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.integrity_findings(_locked(spark, sf_dir), ["page_id"]).where(F.col("category") == category).select("page_id", "tool", "severity", "message", "evidence")

    return query


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", names.resolved_host(F.col("url")).alias("locked_host"), names.url_host(F.col("url")).alias("card_host"))


def url_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.site(names.url_host(F.col("url"))).alias("site"))


def lock_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pins over all locked entries of a table."""
    locked = table(spark, sf_dir, "lineitem").select(F.lit("lock").alias("source"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "l_partkey").alias("name"), F.col("l_linenumber").cast("string").alias("version"))
    return D.package_refs(locked, "source").groupBy("ecosystem", "name").agg(F.count("*").alias("pins"))


_HOST = "nullif(lower(regexp_extract({}, '^(?:registry\\+|sparse\\+)?https?://(?:[^/]*@)?([^/:]*)', 1)), '')"
_RAW = "nullif(split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), ':', 1), '')"
_LOCKED = f"l AS (SELECT page_id, {PAGE_ECO} AS ecosystem, {RESOLVED} AS resolved, page_id % 2 = 0 AS ok FROM pages), h AS (SELECT *, {_HOST.format('resolved')} AS host FROM l)"
_OFF = """(ecosystem = 'npm' AND (host = 'registry.npmjs.org' OR host LIKE '%.registry.npmjs.org')) OR (ecosystem = 'pypi' AND (host IN ('files.pythonhosted.org', 'pypi.org') OR host LIKE '%.files.pythonhosted.org' OR host LIKE '%.pypi.org'))
 OR (ecosystem = 'crates' AND (host IN ('static.crates.io', 'crates.io', 'index.crates.io') OR host LIKE '%.crates.io'))"""

QUERIES = {
    "package_json_names": _manifest("package.json", PACKAGE_JSON),
    "requirements_names": _manifest("requirements-dev.txt", REQUIREMENTS),
    "pyproject_names": _manifest("pyproject.toml", PYPROJECT),
    "cargo_names": _manifest("Cargo.toml", CARGO),
    "yarn_lock": _lock("yarn.lock", YARN),
    "pnpm_lock": _lock("pnpm-lock.yaml", PNPM),
    "package_lock_v3": _lock("package-lock.json", LOCK3),
    "package_lock_v1": _lock("npm-shrinkwrap.json", LOCK1),
    "cargo_lock": _lock("Cargo.lock", CARGO_LOCK),
    "poetry_lock": _lock("poetry.lock", POETRY),
    "hashed_requirements": _lock("requirements.txt", HASHED),
    "lock_offregistry": lock_findings("off-registry-resolved"),
    "lock_missing_integrity": lock_findings("missing-integrity"),
    "url_host": url_host,
    "url_site": url_site,
    "lock_pins": lock_pins,
}
SQL = {
    "package_json_names": _manifest_sql("npm", N, "'@scope/target'", "'plain'"),
    "requirements_names": _manifest_sql("pypi", N, f"'Pinned_' || {V}", "'a'"),
    "pyproject_names": _manifest_sql("pypi", N, "'b'", f"'opt' || {V}", "'poe'", "'grp'"),
    "cargo_names": _manifest_sql("crates", N, f"'real' || {V}", "'bld'"),
    "yarn_lock": _lock_sql("npm", (f"'@s/' || {N}", f"'1.' || {V}", "'https://registry.yarnpkg.com/x'", "true"), ("'plain'", "'2'", "NULL", "false")),
    "pnpm_lock": _lock_sql("npm", (N, f"'1.' || {V}", "'https://t.example/x'", "true"), ("'@s/b'", "'2'", "NULL", "true"), ("'c'", "'3'", "NULL", "false")),
    "package_lock_v3": _lock_sql("npm", (N, f"'1.' || {V}", "'https://r/x'", "true"), ("'real'", "NULL", "NULL", "false")),
    "package_lock_v1": _lock_sql("npm", (N, "'1'", "'https://r/x'", "true"), ("'inner'", V, "NULL", "false")),
    "cargo_lock": _lock_sql("crates", (N, f"'1.' || {V}", "'registry+https://github.com/rust-lang/crates.io-index'", "true")),
    "poetry_lock": _lock_sql("pypi", (N, V, "NULL", "true"), ("'bare'", "'1'", "NULL", "false")),
    "hashed_requirements": _lock_sql("pypi", (N, f"'1.' || {V}", "NULL", "true"), ("'dup'", "'2'", "NULL", "true"), ("'m'", "'3.0;python_version<\"3\"'", "NULL", "false")),
    "lock_offregistry": f"""WITH {_LOCKED} SELECT page_id, 'p' || page_id || '@1' AS tool, 'HIGH' AS severity, 'resolves from ' || host AS message, CASE WHEN length(resolved) > 120 THEN left(resolved, 120) || '…' ELSE resolved END AS evidence
FROM h WHERE host IS NOT NULL AND NOT ({_OFF}) AND NOT (ecosystem = 'crates' AND page_id % 6 = 2)""",
    "lock_missing_integrity": f"WITH {_LOCKED} SELECT page_id, 'p' || page_id || '@1' AS tool, 'MEDIUM' AS severity, 'locked without a hash' AS message, CAST(NULL AS VARCHAR) AS evidence FROM h WHERE NOT ok AND resolved IS NOT NULL",
    "url_host": f"SELECT page_id, {_HOST.format('url')} AS locked_host, {_RAW} AS card_host FROM pages",
    "url_site": f"WITH h AS (SELECT page_id, list_filter(string_split({_RAW}, '.'), lambda x: x <> '') AS l FROM pages) SELECT page_id, array_to_string(l[-2:], '.') AS site FROM h",
    "lock_pins": "SELECT 'npm' AS ecosystem, 'p' || l_partkey AS name, count(DISTINCT l_linenumber) AS pins FROM lineitem GROUP BY l_partkey",
}
