"""Queries on packages: verification, inspection, provenance, predicted names, allowlists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corpora, names
from ..operators import allowlist, packages
from ..sources import feeds as source_feeds
from .common import dealt, quoted, table

NOW = "1998-12-01 00:00:00"
ECO = "CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'crates' END"
PKG = """CASE p_partkey WHEN 3 THEN 'expresss' WHEN 6 THEN 'raect' WHEN 9 THEN 'lodash' WHEN 4 THEN 'reqeusts' WHEN 7 THEN 'numpy' WHEN 10 THEN 'Flaskk'
 WHEN 5 THEN 'tokoi' WHEN 8 THEN 'sеrde' WHEN 11 THEN 'serd' WHEN 12 THEN '@acme/widget' ELSE concat(replace(lower(p_name), ' ', '-'), '-', CAST(p_partkey AS VARCHAR(20))) END"""
ASKED = "CASE p_partkey % 5 WHEN 0 THEN '1.0.0' WHEN 1 THEN '9.9.9' ELSE NULL END"
CREATED = "CASE WHEN p_partkey % 9 = 0 THEN '1998-11-20T05:00:00Z' WHEN p_partkey % 10 = 0 THEN 'unknown' ELSE first_day END"
WINDOW = "CASE p_partkey % 3 WHEN 0 THEN 'weekly' WHEN 2 THEN '90-day' ELSE NULL END"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("d"))
    part = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return part.select("p_partkey", "p_size", F.coalesce("n", F.lit(0)).alias("n"), F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_day"), F.expr(ECO).alias("ecosystem"), F.expr(PKG).alias("name"))


#: Downloads of every other part, for fresh squats.
SQUATS = "CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE n * 4 END"


def feeds(spark: SparkSession, sf_dir: str, downloads: str = "n * 4") -> tuple[DataFrame, dict[str, DataFrame]]:
    p = _parts(spark, sf_dir)
    key = ["ecosystem", "name"]
    latest = F.when(F.col("ecosystem") != "crates", F.lit("1.1.0"))
    metadata = p.where("p_partkey % 11 <> 0").select(
        *key, latest.alias("latest_version"), F.when(F.col("ecosystem") != "crates", F.expr(CREATED)).alias("created"), F.array(F.lit("1.0.0"), F.lit("1.1.0")).alias("versions")
    )
    adv = p.withColumn("i", F.explode(F.expr("sequence(1, CASE WHEN p_partkey % 13 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 1 + p_size % 5 ELSE 0 END, 1)"))).where("p_partkey % 13 = 0 or p_partkey % 7 = 0")
    advisories = adv.select(
        *key, F.when(F.expr("p_partkey % 13 = 0"), F.concat(F.lit("MAL-"), "p_partkey")).otherwise(F.concat_ws("-", F.lit("ADV"), "p_partkey", "i")).alias("id"),
        F.when(F.expr("p_partkey % 26 = 0"), F.lit("steals keys")).alias("summary"), F.expr("CASE (p_partkey + i) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'low' WHEN 3 THEN 'odd' ELSE NULL END").alias("severity"),
        F.expr("CASE WHEN p_partkey % 21 = 0 THEN 'yes' END").alias("withdrawn"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN array('1.1.0') END").alias("affected"),
    )
    reputation = p.where("ecosystem <> 'pypi'").select(
        *key, F.when(F.col("ecosystem") == "crates", F.expr(CREATED)).alias("created"), F.when(F.col("ecosystem") == "crates", F.lit("1.1.0")).alias("latest_version"),
        F.expr(downloads).cast("long").alias("downloads"), F.expr(WINDOW).alias("downloads_window"),
    )
    asked = p.select("p_partkey", *key, F.expr(ASKED).alias("version"))
    return asked, {"metadata": metadata, "advisories": advisories, "reputation": reputation}


def _now():
    return F.lit(NOW).cast("timestamp")


def reports(spark: SparkSession, sf_dir: str, downloads: str = "n * 4") -> DataFrame:
    asked, f = feeds(spark, sf_dir, downloads)
    return packages.verify(asked, now=_now(), **f)


def verify_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("p_partkey", "verdict", "reason")


def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.verdict_counts(reports(spark, sf_dir), "ecosystem")


def verify_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit state of a run over each ecosystem: 1 if anything is flagged."""
    return reports(spark, sf_dir).groupBy("ecosystem").agg(F.bool_or("flagged").cast("int").alias("exit_code"), F.count("*").alias("checked"))


def lookalike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of the popular names by part."""
    top = packages.popular(spark).withColumnRenamed("ord", "place")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 87).cast("int").alias("place"), (F.col("p_partkey") % 5).alias("how"))
    m = top.join(p, "place")
    n = F.length("top")
    k = (F.col("p_partkey") % 3 + 2).cast("int")
    swapped = F.concat(F.substr("top", F.lit(1), k - 1), F.substr("top", k + 1, F.lit(1)), F.substr("top", k, F.lit(1)), F.substr("top", k + 2))
    name = F.when(F.col("how") == 0, F.concat("top", F.substr("top", n))).when(F.col("how") == 1, swapped).when(F.col("how") == 2, F.translate("top", "aeo", "аеο")).when(F.col("how") == 3, F.substr("top", F.lit(2))).otherwise(F.concat("top", F.lit("xy")))
    pk = m.select("ecosystem", name.alias("name"))
    return packages.lookalikes(pk)


COMMANDS = """CASE p_partkey % 14 WHEN 0 THEN concat('npx -y ', p_brand, '@1.0') WHEN 1 THEN 'node build/index.js' WHEN 2 THEN 'python -m mcp_server --port 1' WHEN 3 THEN 'python3 server.py'
 WHEN 4 THEN 'uvx --from git+https://x.example/r tool' WHEN 5 THEN 'uv tool run  some-tool' WHEN 6 THEN 'cargo install --locked ripgrep' WHEN 7 THEN 'npx' WHEN 8 THEN '   '
 WHEN 9 THEN '@scope/pkg@2' WHEN 10 THEN './local/run' WHEN 11 THEN 'pnpm dlx -p left-pad cmd' WHEN 12 THEN 'owner/repo' ELSE 'bare-name' END"""


def command_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(COMMANDS).alias("spec"))
    return packages.resolve_commands(rows).drop("spec")


SPECS = "CASE o_orderkey % 6 WHEN 0 THEN 'left-pad' WHEN 1 THEN '@scope/x' WHEN 2 THEN concat('@scope/x@', CAST(o_custkey AS VARCHAR(20))) WHEN 3 THEN 'a@1@2' WHEN 4 THEN 'bad@' ELSE concat('p', CAST(o_custkey AS VARCHAR(20)), '@^1.0') END"


def package_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr(SPECS)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(names.spec_valid(s), names.spec_name(s)).alias("name"), F.when(names.spec_valid(s), names.spec_version(s)).alias("version"), names.spec_valid(s).alias("valid"))


def inspect_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust of each package with a planted worst finding."""
    r = reports(spark, sf_dir).withColumn("worst", F.expr("CASE p_partkey % 8 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END"))
    return r.select("p_partkey", packages.inspect_trust(F.col("verdict"), F.col("worst"), F.expr("p_partkey % 10 <> 4")).alias("trust"))


ATTEST = """CASE p_partkey % 5 WHEN 0 THEN '{"url":"https://x"}' WHEN 1 THEN '{"provenance":1}' WHEN 2 THEN '{"url":""}' WHEN 3 THEN '[1]' ELSE NULL END"""
REPO = "CASE p_partkey % 4 WHEN 0 THEN concat('https://git.example/', lower(substr(NM, 1, 200))) WHEN 1 THEN 'https://git.example/acme/other' ELSE NULL END"


def provenance_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    attested = r.select("ecosystem", "name", packages.attestation_presence(F.expr(ATTEST)).alias("presence"), F.expr(REPO.replace("NM", "name")).alias("source_repo"))
    found = packages.provenance(r.select("p_partkey", "ecosystem", "name", "verdict"), attested, ["p_partkey"])
    return found.select("p_partkey", "severity", "category", "message")


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(ECO).alias("ecosystem"), F.expr(PKG).alias("name"), F.col("p_partkey").alias("ord"))


def foresee_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.predicted_names(_existing(spark, sf_dir), 80)


def foresee_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = packages.classify_predicted(reports(spark, sf_dir, SQUATS), _now())
    return r.select("p_partkey", "guard", "trap")


def allowlist_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    allowed = r.where("p_partkey % 4 = 1").select("ecosystem", "name", F.coalesce("version", "latest_version").alias("version"))
    return packages.apply_allowlist(r, allowed).select("p_partkey", "verdict", "flagged")


def fingerprint_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose fingerprint is allowed are marked, not scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fp"))
    allowed = docs.where("doc_id % 10 = 0").select(F.lit("memory").alias("kind"), F.col("fp").alias("fingerprint"))
    trusted, rest = allowlist.split_trusted(docs, allowed, "memory", "fp")
    return trusted.select("doc_id", F.lit("trusted").alias("state")).unionByName(rest.select("doc_id", F.lit("scan").alias("state")))


_POP = "pop(ecosystem, ord, top) AS (VALUES " + ", ".join(f"('{e}', {i}, '{n}')" for e, xs in corpora.POPULAR.items() for i, n in enumerate(xs)) + ")"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_SKEL = f"translate(translate(lower(name), '{corpora.PACKAGE_FOLD[0]}', '{corpora.PACKAGE_FOLD[1]}'), {quoted(_WIDE)}, {quoted(''.join(chr(ord(x) - 0xFEE0) for x in _WIDE))})"
_LOOK = f"""lk AS (SELECT n.ecosystem, n.name, arg_min(pop.top, (CASE WHEN {_SKEL.replace('name', 'n.name')} = top THEN 0 ELSE 1 END) * 1000 + ord) AS lookalike
 FROM (SELECT DISTINCT ecosystem, name FROM names WHERE NOT EXISTS (SELECT 1 FROM pop WHERE pop.ecosystem = names.ecosystem AND pop.top = names.name)) n JOIN pop ON pop.ecosystem = n.ecosystem
 AND ({_SKEL.replace('name', 'n.name')} = top OR (length(n.name) >= 4 AND length(top) >= 4 AND abs(length(n.name) - length(top)) <= 1 AND damerau_levenshtein(lower(n.name), top) = 1)) GROUP BY 1, 2)"""
_BASE = f"""{_POP}, ln AS (SELECT l_partkey, count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%SZ') AS first_day FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, p_size, coalesce(n, 0) AS n, first_day, {ECO} AS ecosystem, {PKG} AS name, {ASKED} AS version, p_partkey % 11 <> 0 AS found FROM part LEFT JOIN ln ON l_partkey = p_partkey),
names AS (SELECT ecosystem, name FROM p), {_LOOK},
s AS (SELECT p.*, CASE WHEN found AND version IS NOT NULL THEN version = '1.0.0' END AS published, p_partkey % 13 = 0 AND p_partkey % 21 <> 0 AND
  (p_partkey % 4 <> 0 OR coalesce(version, CASE WHEN found AND ecosystem <> 'crates' THEN '1.1.0' END, '1.1.0') = '1.1.0') AS mal,
 CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 7 = 0 AND p_partkey % 21 <> 0 AND (p_partkey % 4 <> 0 OR coalesce(version, CASE WHEN found AND ecosystem <> 'crates' THEN '1.1.0' END, '1.1.0') = '1.1.0') THEN 1 + p_size % 5 ELSE 0 END AS nv FROM p),
v AS (SELECT s.*, found AND NOT mal AND nv = 0 AND coalesce(published, true) AND ecosystem <> 'pypi' AS need FROM s),
r AS (SELECT v.*, CASE WHEN need THEN n * 4 END AS downloads, CASE WHEN need THEN {WINDOW} END AS win,
 CASE WHEN found AND ecosystem <> 'crates' OR need AND ecosystem = 'crates' THEN {CREATED} END AS created,
 CASE WHEN found AND ecosystem <> 'crates' OR need AND ecosystem = 'crates' THEN '1.1.0' END AS latest, CASE WHEN found AND NOT mal THEN lookalike END AS look
 FROM v LEFT JOIN lk USING (ecosystem, name)),
a AS (SELECT r.*, date_sub('day', try_cast(replace(replace(created, 'T', ' '), 'Z', '') AS TIMESTAMP), TIMESTAMP '{NOW}') AS age,
 list_sort(list_transform(range(1, nv + 1), lambda i: 'ADV-' || p_partkey || '-' || i)) AS ids,
 list_max(list_transform(range(1, nv + 1), lambda i: CASE (p_partkey + i) % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END)) AS top FROM r),
w AS (SELECT a.*, CASE WHEN mal THEN 'MALICIOUS' WHEN NOT found THEN 'MISSING' WHEN published = false THEN 'MISSING' WHEN look IS NOT NULL THEN 'LOOKALIKE' WHEN nv > 0 THEN 'VULNERABLE'
 WHEN coalesce(age < 30, false) OR coalesce(downloads < 100, false) THEN 'SUSPICIOUS' ELSE 'OK' END AS verdict FROM a)"""
_REASON = """CASE verdict WHEN 'MALICIOUS' THEN 'reported as malicious (MAL-' || p_partkey || ')' || CASE WHEN p_partkey % 26 = 0 THEN ': steals keys' ELSE '' END
 WHEN 'MISSING' THEN CASE WHEN NOT found THEN 'not in the registry' ELSE 'this version was never published' END
 WHEN 'LOOKALIKE' THEN 'close to the popular package ' || look
 WHEN 'VULNERABLE' THEN nv || ' advisories' || coalesce(', highest ' || CASE top WHEN 4 THEN 'CRITICAL' WHEN 2 THEN 'MODERATE' WHEN 1 THEN 'LOW' WHEN 0 THEN 'unknown' END, '') || ': ' || array_to_string(ids[1:3], ', ') || CASE WHEN nv > 3 THEN ' and ' || (nv - 3) || ' more' ELSE '' END
 WHEN 'SUSPICIOUS' THEN concat_ws('; ', CASE WHEN age < 30 THEN 'created ' || age || ' days ago' END, CASE WHEN downloads < 100 THEN 'only ' || downloads || ' ' || coalesce(win, 'recent') || ' downloads' END)
 ELSE coalesce(nullif(concat_ws(', ', 'latest ' || latest, downloads || ' ' || coalesce(win, 'recent') || ' downloads'), ''), 'exists, nothing against it') END"""
_PROV = f"""t AS (SELECT w.*, CASE p_partkey % 5 WHEN 0 THEN 'W' WHEN 1 THEN 'M' WHEN 2 THEN 'M' ELSE 'A' END AS pr, {REPO.replace('NM', 'name')} AS repo FROM w)"""
_BARE = "lower(regexp_replace(name, '^@[^/]*/', ''))"
_FORE = """e AS (SELECT {eco} AS ecosystem, {pkg} AS name, p_partkey AS ord FROM part),
{tables},
sd AS (SELECT ecosystem, seed, min(g * 1000000000000 + place) AS place FROM (SELECT ecosystem, lower(regexp_replace(name, '^@[^/]*/', '')) AS seed, 0 AS g, ord AS place FROM e UNION ALL SELECT ecosystem, seed, 1, place FROM mg) GROUP BY 1, 2),
vr AS (SELECT sd.ecosystem, lower(pre || seed || suf) AS predicted, min(sd.place * 1000 + affix_ord) AS spot FROM sd JOIN af ON af.ecosystem = sd.ecosystem GROUP BY 1, 2),
o AS (SELECT ecosystem, predicted, row_number() OVER (PARTITION BY ecosystem ORDER BY spot) - 1 AS ord FROM vr WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ecosystem = vr.ecosystem AND lower(e.name) = predicted))"""
AFFIX_SQL = "af(ecosystem, affix_ord, pre, suf) AS (VALUES {affixes}), mg(ecosystem, seed, place) AS (VALUES {magnets})".format(
    affixes=", ".join(f"('{e}', {i}, '{a}', '{b}')" for e, (s, p) in corpora.AFFIXES.items() for i, (a, b) in enumerate([("", y) for y in s] + [(y, "") for y in p])),
    magnets=", ".join(f"('{e}', '{n}', {i})" for e, xs in corpora.MAGNETS.items() for i, n in enumerate(xs)),
)
_FORE = _FORE.format(eco=ECO, pkg=PKG, tables=AFFIX_SQL)

#: The same packages with the downloads of fresh squats.
SQUAT_BASE = _BASE.replace("CASE WHEN need THEN n * 4 END", f"CASE WHEN need THEN {SQUATS} END")
#: What isn't there, and every trap, is on the do-not-install list.
GUARD = """t AS (SELECT *, verdict IN ('MALICIOUS', 'LOOKALIKE') OR (verdict <> 'MISSING' AND coalesce(age <= 365, false) AND coalesce(downloads < 50, true)) AS trap FROM w),
g AS (SELECT *, verdict = 'MISSING' OR trap AS guard FROM t)"""

# Versions of parts with pre-releases and post-releases, and advisories with ranges.
VERSION = """CASE WHEN p_partkey % 11 = 0 THEN 'latest' ELSE concat(CAST(p_size % 4 AS VARCHAR(9)), '.', CAST(p_partkey % 3 AS VARCHAR(9)), CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.0' END,
 CASE WHEN p_partkey % 3 <> 1 AND p_partkey % 5 = 0 THEN concat('-rc.', CAST(p_partkey % 12 AS VARCHAR(9))) WHEN p_partkey % 3 <> 1 AND p_partkey % 5 = 1 THEN '-rc.x+b7' WHEN p_partkey % 3 = 1 AND p_partkey % 5 = 0 THEN concat('RC', CAST(p_partkey % 12 AS VARCHAR(9)))
 WHEN p_partkey % 3 = 1 AND p_partkey % 5 = 1 THEN '.dev3' WHEN p_partkey % 3 = 1 AND p_partkey % 5 = 2 THEN '.post1' ELSE '' END) END"""
#: Introduced, fixed and last affected versions, by the id of the advisory, for npm and crates, then for PyPI.
EVENTS = {
    "ADV-A": (("0", "2.1.0", None), ("0", "2.1", None)),
    "ADV-B": (("1.0.0", None, "1.2.0"), ("1.0", None, "1.2")),
    "ADV-C": (("3.0.0", None, None), ("3", None, None)),
    "ADV-D": (("2.0.0-rc.3", "2.0.0", None), ("2.0rc3", "2.0", None)),
    "ADV-E": (("1.1.0-rc.10", None, "2.2.0-rc.x"), ("1.1.dev4", None, "2.2rc11")),
}


def _advisory_body(kind: int) -> str:
    event = lambda k, v: [] if v is None else [{k: v}]
    vulns = [{"id": i, "affected": [{"ranges": [{"type": "GIT", "events": [{"introduced": "0"}]}, {"type": "ECOSYSTEM" if kind else "SEMVER", "events": event("fixed", e[kind][1]) + event("last_affected", e[kind][2]) + event("introduced", e[kind][0])}]}]} for i, e in EVENTS.items()]
    vulns += [{"id": "ADV-F", "affected": [{"versions": ["latest"]}, {"ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "9"}]}]}]}, {"id": "ADV-G", "withdrawn": "2020", "affected": [{"versions": ["latest"]}]}, {"id": "ADV-H"}]
    return json.dumps({"vulns": vulns})


def advisory_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which advisories each part's version is affected by."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.expr(ECO).alias("ecosystem"), F.col("p_partkey").cast("string").alias("name"), F.expr(VERSION).alias("version"))
    bodies = p.select("ecosystem", "name", F.lit(200).alias("status"), F.when(F.col("ecosystem") == "pypi", _advisory_body(1)).otherwise(_advisory_body(0)).alias("body"))
    found = packages.with_advisories(p.withColumn("effective", F.col("version")), source_feeds.advisories(bodies))
    return found.select("p_partkey", "version", F.array_join(F.transform("vulnerabilities", lambda v: v["id"]), ",").alias("ids"))


def lookalike_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a part's name and a popular one that the index of edits gives."""
    p = table(spark, sf_dir, "part").select(F.expr(ECO).alias("ecosystem"), F.lower(F.expr(PKG)).alias("name"))
    return packages.lookalike_candidates(p).select("ecosystem", "name", "top")


#: A version as a row of numbers: major, minor, stage (development, pre-release, release, post-release), kind and number of the stage.
_V = """v AS (SELECT p_partkey, p_partkey % 3 = 1 AS py, p_partkey % 11 = 0 AS odd, [p_size % 4, p_partkey % 3, CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 5 = 1 THEN CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 1 END WHEN p_partkey % 5 = 2 AND p_partkey % 3 = 1 THEN 3 ELSE 2 END,
 CASE WHEN p_partkey % 5 = 1 AND p_partkey % 3 <> 1 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 12 WHEN p_partkey % 5 = 1 AND p_partkey % 3 = 1 THEN 3 ELSE 0 END] AS k FROM part)"""
ADVISORY_SQL = f"""WITH {_V}, h AS (SELECT p_partkey, py, odd, k FROM v)
SELECT p_partkey, {VERSION} AS version, array_to_string(list_filter([
 CASE WHEN NOT odd AND k < [2, 1, 2, 0, 0] THEN 'ADV-A' END, CASE WHEN NOT odd AND k >= [1, 0, 2, 0, 0] AND k <= [1, 2, 2, 0, 0] THEN 'ADV-B' END, CASE WHEN NOT odd AND k >= [3, 0, 2, 0, 0] THEN 'ADV-C' END,
 CASE WHEN NOT odd AND k >= [2, 0, 1, 0, 3] AND k < [2, 0, 2, 0, 0] THEN 'ADV-D' END,
 CASE WHEN NOT odd AND NOT py AND k >= [1, 1, 1, 0, 10] AND k <= [2, 2, 1, 1, 0] OR NOT odd AND py AND k >= [1, 1, 0, 0, 4] AND k <= [2, 2, 1, 0, 11] THEN 'ADV-E' END,
 CASE WHEN odd THEN 'ADV-F' END, 'ADV-H'], lambda x: x IS NOT NULL), ',') AS ids FROM h JOIN part USING (p_partkey)"""

QUERIES = {
    "verify_ladder": verify_ladder,
    "advisory_ranges": advisory_ranges,
    "lookalike_candidates": lookalike_candidates,
    "verify_summary": verify_summary,
    "verify_flagged": verify_flagged,
    "lookalike": lookalike,
    "command_resolve": command_resolve,
    "package_spec": package_spec,
    "inspect_decide": inspect_decide,
    "provenance_presence": provenance_presence,
    "foresee_candidates": foresee_candidates,
    "foresee_traps": foresee_traps,
    "allowlist_override": allowlist_override,
    "fingerprint_skip": fingerprint_skip,
}
SQL = {
    "verify_ladder": f"WITH {_BASE} SELECT p_partkey, verdict, {_REASON} AS reason FROM w",
    "verify_summary": f"WITH {_BASE} SELECT ecosystem, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v.lower()}" for v in corpora.VERDICTS) + " FROM w GROUP BY ecosystem",
    "verify_flagged": f"WITH {_BASE} SELECT ecosystem, max((verdict <> 'OK')::INT) AS exit_code, count(*) AS checked FROM w GROUP BY ecosystem",
    "lookalike": f"""WITH {_POP}, m AS (SELECT pop.ecosystem, top, p_partkey, (p_partkey % 3 + 2)::INT AS k, p_partkey % 5 AS how FROM part JOIN pop ON pop.ord = p_partkey % 87),
names AS (SELECT ecosystem, CASE how WHEN 0 THEN top || substr(top, length(top)) WHEN 1 THEN substr(top, 1, k - 1) || substr(top, k + 1, 1) || substr(top, k, 1) || substr(top, k + 2)
 WHEN 2 THEN translate(top, 'aeo', 'аеο') WHEN 3 THEN substr(top, 2) ELSE top || 'xy' END AS name FROM m), {_LOOK} SELECT ecosystem, name, lookalike FROM lk""",
    "command_resolve": """SELECT p_partkey, CASE p_partkey % 14 WHEN 0 THEN 'npm' WHEN 2 THEN 'pypi' WHEN 5 THEN 'pypi' WHEN 6 THEN 'crates' WHEN 9 THEN 'npm' WHEN 11 THEN 'npm' WHEN 13 THEN 'npm' END AS ecosystem,
 CASE p_partkey % 14 WHEN 0 THEN split_part(p_brand || '@1.0', ' ', 1) WHEN 2 THEN 'mcp_server' WHEN 5 THEN 'some-tool' WHEN 6 THEN 'ripgrep' WHEN 9 THEN '@scope/pkg@2' WHEN 11 THEN 'left-pad' WHEN 13 THEN 'bare-name' END AS package,
 CASE WHEN p_partkey % 14 IN (1, 3, 4, 10, 12) THEN 'unverifiable' WHEN p_partkey % 14 IN (7, 8) THEN 'error' END AS note FROM part""",
    "package_spec": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'left-pad' WHEN 1 THEN '@scope/x' WHEN 2 THEN '@scope/x' WHEN 3 THEN 'a' WHEN 5 THEN 'p' || o_custkey END AS name,
 CASE o_orderkey % 6 WHEN 2 THEN o_custkey::VARCHAR WHEN 3 THEN '1@2' WHEN 5 THEN '^1.0' END AS version, o_orderkey % 6 <> 4 AS valid FROM orders""",
    "inspect_decide": f"""WITH {_BASE} SELECT p_partkey, CASE WHEN verdict IN ('MALICIOUS', 'MISSING', 'LOOKALIKE') OR p_partkey % 8 = 1 THEN 'AVOID'
 WHEN verdict IN ('SUSPICIOUS', 'VULNERABLE') OR p_partkey % 10 = 4 OR p_partkey % 8 = 2 THEN 'REVIEW' ELSE 'GREEN' END AS trust FROM w""",
    "provenance_presence": f"""WITH {_BASE}, {_PROV}
SELECT p_partkey, 'HIGH' AS severity, 'registry' AS category, 'registry verdict ' || verdict AS message FROM t WHERE verdict IN ('MISSING', 'MALICIOUS', 'LOOKALIKE')
UNION ALL SELECT p_partkey, 'INFO', 'provenance', 'no attestations in this ecosystem' FROM t WHERE ecosystem = 'crates'
UNION ALL SELECT p_partkey, 'INFO', 'provenance', 'attestation present, not verified' FROM t WHERE ecosystem <> 'crates' AND pr = 'W'
UNION ALL SELECT p_partkey, 'MEDIUM', 'provenance', 'attestation malformed' FROM t WHERE ecosystem <> 'crates' AND pr = 'M'
UNION ALL SELECT p_partkey, 'LOW', 'provenance', 'no attestation' FROM t WHERE ecosystem <> 'crates' AND pr = 'A' AND verdict = 'OK'
UNION ALL SELECT p_partkey, 'LOW', 'source-repo', 'repository doesn''t name the package' FROM t WHERE repo IS NOT NULL AND NOT contains(lower(repo), {_BARE}) AND NOT (name LIKE '@%/%' AND contains(lower(repo), lower(regexp_extract(name, '^@([^/]+)/', 1))))""",
    "foresee_candidates": f"WITH {_FORE} SELECT ecosystem, predicted, ord FROM o WHERE ord < 80",
    "foresee_traps": f"WITH {SQUAT_BASE}, {GUARD} SELECT p_partkey, guard, trap FROM g",
    "advisory_ranges": ADVISORY_SQL,
    "lookalike_candidates": f"""WITH {_POP}, names AS (SELECT DISTINCT {ECO} AS ecosystem, lower({PKG}) AS name FROM part),
t AS (SELECT ecosystem, top, unnest(list_append(list_transform(range(1, length(top) + 1), lambda i: substr(top, 1, i - 1) || substr(top, i + 1)), top)) AS k FROM pop WHERE length(top) >= 4),
n AS (SELECT ecosystem, name, unnest(list_append(list_transform(range(1, length(name) + 1), lambda i: substr(name, 1, i - 1) || substr(name, i + 1)), name)) AS k FROM names WHERE length(name) >= 4)
SELECT DISTINCT n.ecosystem, n.name, t.top FROM n JOIN t USING (ecosystem, k) WHERE NOT EXISTS (SELECT 1 FROM pop WHERE pop.ecosystem = n.ecosystem AND pop.top = n.name)""",
    "allowlist_override": f"""WITH {_BASE}, z AS (SELECT *, p_partkey % 4 = 1 AND coalesce(version, latest) IS NOT NULL AS ok FROM w)
SELECT p_partkey, CASE WHEN ok THEN 'OK' ELSE verdict END AS verdict, NOT ok AND verdict <> 'OK' AS flagged FROM z""",
    "fingerprint_skip": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS f FROM documents)
SELECT doc_id, CASE WHEN f IN (SELECT f FROM d WHERE doc_id % 10 = 0) THEN 'trusted' ELSE 'scan' END AS state FROM d""",
}
