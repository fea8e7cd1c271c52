"""Packages against feeds: verification, inspection, provenance, predicted names.

Feeds are tables (see sources.feeds).  Joins are equalities on (ecosystem, name);
Spark chooses how to run them from the sizes of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import corpora, names
from ..functions import text as T
from ..schemas import rank
from ..sources import feeds as feed_tables
from ..sources import files
from . import allowlist, dependencies, text_rules
from .text_rules import finding

MIN_AGE_DAYS, MIN_DOWNLOADS = 30, 100
TRAP_AGE_DAYS, TRAP_DOWNLOADS = 365, 50


def popular(spark: SparkSession) -> DataFrame:
    rows = [(e, i, n) for e, xs in corpora.POPULAR.items() for i, n in enumerate(xs)]
    return spark.createDataFrame(rows, "ecosystem string, ord int, top string")


def _near_keys(name: Column) -> Column:
    """A name and what is left of it without one of its characters.  Names one edit or one swap of neighbours apart share one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    return F.array_distinct(F.concat(F.array(name), F.transform(places, lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))))


def lookalike_candidates(packages: DataFrame) -> DataFrame:
    """``ecosystem, name, _low, _skel, ord, top``: names that aren't popular, beside the popular ones that share a key with them.

    The index holds the keys of 203 names, about 2,000 rows, so it is broadcast; a name meets the few popular ones that
    it may be an edit of, not all of its ecosystem.
    """
    top = popular(packages.sparkSession)
    known = F.broadcast(top.select("ecosystem", F.col("top").alias("name")))
    fresh = packages.select("ecosystem", "name").distinct().join(known, ["ecosystem", "name"], "left_anti")
    fresh = fresh.withColumn("_low", F.lower("name")).withColumn("_skel", names.package_skeleton(F.col("name")))
    same = lambda c: F.array(F.concat(F.lit("="), c))
    edits = lambda c: F.when(F.length(c) >= 4, _near_keys(c)).otherwise(F.array().cast("array<string>"))
    index = F.broadcast(top.select(F.col("ecosystem").alias("_e"), "ord", "top", F.explode(F.concat(same(F.col("top")), edits(F.col("top")))).alias("_k")))
    keyed = fresh.withColumn("_key", F.explode(F.concat(same(F.col("_skel")), edits(F.col("_low")))))
    met = keyed.join(index, (F.col("ecosystem") == F.col("_e")) & (F.col("_key") == F.col("_k")))
    return met.select("ecosystem", "name", "_low", "_skel", "ord", "top").distinct()


def lookalikes(packages: DataFrame) -> DataFrame:
    """``ecosystem, name, lookalike``: the popular package that a name mimics.

    Equal skeletons first, then one edit; the first in list order.
    """
    near = F.abs(F.length("_low") - F.length("top")) <= 1
    same = F.col("_skel") == F.col("top")
    edit = (F.length("_low") >= 4) & (F.length("top") >= 4) & names.one_edit(F.col("_low"), F.col("top"))
    order = F.struct(F.when(same, 0).otherwise(1).alias("phase"), "ord")
    return lookalike_candidates(packages).where(near & (same | edit)).groupBy("ecosystem", "name").agg(F.min_by("top", order).alias("lookalike"))


def advisory_ids(ids: Column) -> Column:
    more = F.size(ids) - 3
    return F.concat(F.array_join(F.slice(ids, 1, 3), ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(F.lit("")))


def highest_severity(severities: Column) -> Column:
    """Of those that are given; ``unknown`` for a label without a rank."""
    place = lambda s: F.when(s == "CRITICAL", 4).when(s == "HIGH", 3).when(s.isin("MODERATE", "MEDIUM"), 2).when(s == "LOW", 1).otherwise(0)
    top = F.array_max(F.transform(F.filter(severities, lambda s: s.isNotNull()), place))
    return F.when(top == 4, "CRITICAL").when(top == 3, "HIGH").when(top == 2, "MODERATE").when(top == 1, "LOW").when(top == 0, "unknown")


def with_metadata(packages: DataFrame, metadata: DataFrame) -> DataFrame:
    """J: existence, versions and creation; ``published`` is null unless a version is asked for."""
    m = metadata.select("ecosystem", "name", "latest_version", "created", "versions", F.lit(True).alias("_found"))
    out = packages.join(m, ["ecosystem", "name"], "left").withColumn("exists", F.coalesce("_found", F.lit(False))).drop("_found")
    published = F.when(F.col("exists") & F.col("version").isNotNull(), F.array_contains("versions", F.col("version")))
    return out.withColumn("published", published).withColumn("effective", F.coalesce("version", "latest_version"))


def with_advisories(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Advisories at the effective version; without one, of any version.  Malicious reports are kept apart.

    ``advisories``: ``ecosystem, name, id, summary, severity, withdrawn, affected`` and, if there is one,
    ``ranges`` (as ``feeds.advisories`` gives them).  A version is affected if it is listed, if its key lies in an
    interval, or if the advisory has neither list nor ranges; one that has no key lies in none.
    """
    ranges = F.col("ranges") if "ranges" in advisories.columns else F.lit(None).cast(feed_tables.RANGES)
    a = advisories.where("withdrawn is null").select("ecosystem", "name", "id", "summary", F.upper("severity").alias("severity"), "affected", ranges.alias("ranges"))
    asked = packages.select("ecosystem", "name", "version", "effective").distinct().withColumn("_key", names.version_key(F.col("ecosystem"), F.col("effective")))
    below = lambda r: r["high"].isNull() | (F.col("_key") < r["high"]) | (r["closed"] & (F.col("_key") == r["high"]))
    inside = F.coalesce(F.exists("ranges", lambda r: (F.col("_key") >= r["low"]) & below(r)), F.lit(False))
    listed = F.coalesce(F.array_contains("affected", F.col("effective")), F.lit(False))
    everything = F.col("effective").isNull() | (F.col("affected").isNull() & F.col("ranges").isNull())
    # Feeds and packages both grow, and what is parsed from a feed is larger than its files let Spark guess: no broadcast.
    hit = asked.join(a.hint("merge"), ["ecosystem", "name"]).where(everything | listed | inside)
    mal = F.startswith("id", F.lit("MAL-"))
    per = hit.groupBy("ecosystem", "name", "version").agg(
        F.array_sort(F.collect_set(F.when(mal, F.col("id")))).alias("malicious_ids"),
        F.min_by("summary", F.when(mal & F.col("summary").isNotNull(), F.col("id"))).alias("malicious_summary"),
        F.sort_array(F.collect_set(F.when(~mal, F.struct("id", "severity")))).alias("vulnerabilities"),
    )
    key = ["ecosystem", "name"]
    p = per.select(*[F.col(k).alias(f"_{k}") for k in (*key, "version")], "malicious_ids", "malicious_summary", "vulnerabilities")
    on = (F.col("ecosystem") == F.col("_ecosystem")) & (F.col("name") == F.col("_name")) & F.col("version").eqNullSafe(F.col("_version"))
    out = packages.join(p.hint("merge"), on, "left").drop("_ecosystem", "_name", "_version")
    return out.withColumn("malicious_ids", F.coalesce("malicious_ids", F.array().cast("array<string>"))).withColumn(
        "vulnerabilities", F.coalesce("vulnerabilities", F.array().cast("array<struct<id:string,severity:string>>"))
    )


def with_reputation(packages: DataFrame, reputation: DataFrame) -> DataFrame:
    """Downloads, only for packages whose verdict can depend on them.  Fills gaps in creation and latest version."""
    needed = F.col("exists") & (F.size("malicious_ids") == 0) & (F.size("vulnerabilities") == 0) & F.coalesce(F.col("published"), F.lit(True))
    r = reputation.select(F.col("ecosystem").alias("_e"), F.col("name").alias("_n"), F.col("created").alias("_c"), F.col("latest_version").alias("_l"), "downloads", "downloads_window")
    out = packages.withColumn("_need", needed)
    out = out.join(r, (F.col("ecosystem") == F.col("_e")) & (F.col("name") == F.col("_n")) & F.col("_need"), "left")
    out = out.withColumn("created", F.coalesce("created", "_c")).withColumn("latest_version", F.coalesce("latest_version", "_l"))
    return out.drop("_e", "_n", "_c", "_l", "_need")


def verdict_ladder(signals: DataFrame, now: Column, min_age_days: int = MIN_AGE_DAYS, min_downloads: int = MIN_DOWNLOADS) -> DataFrame:
    """Adds ``verdict, reason``.  The first rung that holds decides."""
    ids = F.transform("vulnerabilities", lambda v: v["id"])
    worst = highest_severity(F.transform("vulnerabilities", lambda v: v["severity"]))
    age = names.age_days(F.col("created"), now)
    window = F.coalesce("downloads_window", F.lit("recent"))
    young, rare = F.coalesce(age < min_age_days, F.lit(False)), F.coalesce(F.col("downloads") < min_downloads, F.lit(False))
    doubts = F.concat_ws("; ", F.when(young, F.concat(F.lit("created "), age, F.lit(" days ago"))), F.when(rare, F.concat_ws(" ", F.lit("only"), "downloads", window, F.lit("downloads"))))
    fine = F.concat_ws(", ", F.when(F.col("latest_version").isNotNull(), F.concat(F.lit("latest "), "latest_version")), F.when(F.col("downloads").isNotNull(), F.concat_ws(" ", "downloads", window, F.lit("downloads"))))
    n = F.size("vulnerabilities")
    rungs = [
        (F.size("malicious_ids") > 0, "MALICIOUS", F.concat(F.lit("reported as malicious ("), F.array_join("malicious_ids", ", "), F.lit(")"), F.coalesce(F.concat(F.lit(": "), "malicious_summary"), F.lit("")))),
        (~F.col("exists"), "MISSING", F.lit("not in the registry")),
        (F.col("published").eqNullSafe(False), "MISSING", F.lit("this version was never published")),
        (F.col("lookalike").isNotNull(), "LOOKALIKE", F.concat(F.lit("close to the popular package "), "lookalike")),
        (n > 0, "VULNERABLE", F.concat(n, F.lit(" advisories"), F.coalesce(F.concat(F.lit(", highest "), worst), F.lit("")), F.lit(": "), advisory_ids(ids))),
        (young | rare, "SUSPICIOUS", doubts),
    ]
    verdict, reason = F, F
    for cond, v, r in rungs:
        verdict, reason = verdict.when(cond, v), reason.when(cond, r)
    return signals.withColumns({"verdict": verdict.otherwise("OK"), "reason": reason.otherwise(F.when(fine == "", "exists, nothing against it").otherwise(fine))})


def verify(packages: DataFrame, metadata: DataFrame, advisories: DataFrame, reputation: DataFrame, now: Column, **thresholds) -> DataFrame:
    """``packages``: ``ecosystem, name, version``.  One report per row."""
    p = with_advisories(with_metadata(packages, metadata), advisories)
    like = lookalikes(p.where("exists and size(malicious_ids) = 0"))
    p = with_reputation(p, reputation).join(like, ["ecosystem", "name"], "left")
    p = p.withColumn("lookalike", F.when(F.col("exists") & (F.size("malicious_ids") == 0), F.col("lookalike")))
    return verdict_ladder(p, now, **thresholds).withColumn("flagged", F.col("verdict") != "OK")


def apply_allowlist(reports: DataFrame, allowed: DataFrame) -> DataFrame:
    """``allowed``: ``ecosystem, name, version``.  An exact pin that is allowed is OK; its reason keeps the old verdict."""
    a = allowed.select(F.col("ecosystem").alias("_e"), F.col("name").alias("_n"), F.col("version").alias("_v")).distinct()
    on = (F.col("ecosystem") == F.col("_e")) & (F.col("name") == F.col("_n")) & (F.coalesce("version", "latest_version") == F.col("_v"))
    hit = F.col("_e").isNotNull() & (F.col("verdict") != "OK")
    out = reports.join(a, on, "left").withColumn("reason", F.when(hit, F.concat_ws(" ", F.lit("allowed, was"), "verdict")).otherwise(F.col("reason")))
    return out.withColumn("verdict", F.when(hit, "OK").otherwise(F.col("verdict"))).withColumn("flagged", F.col("verdict") != "OK").drop("_e", "_n", "_v")


def verdict_counts(reports: DataFrame, *keys: str) -> DataFrame:
    return reports.groupBy(*keys).agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in corpora.VERDICTS])


# Install commands

def resolve_commands(commands: DataFrame, spec: str = "spec") -> DataFrame:
    """Adds ``ecosystem, package, note`` of an install command.

    ``note``: ``unverifiable`` for scripts, paths and URLs; ``error`` for an empty
    command or a runner without a package.
    """
    c, at = F.col, lambda a, i: F.get(a, i.cast("int"))
    df = T.once(commands, _tokens=F.filter(F.split(F.coalesce(T.trimmed(c(spec)), F.lit("")), r"\s+"), lambda x: x != ""))
    df = T.once(df, _first=F.get("_tokens", F.lit(0)), _rest=F.slice("_tokens", 2, F.greatest(F.size("_tokens") - 1, F.lit(0))), _m=F.array_position("_tokens", "-m"))
    runner = F
    for eco, cmds in corpora.RUNNERS.items():
        runner = runner.when(c("_first").isin(cmds), eco)
    # The first token that is a package flag (2), or neither a flag nor a subcommand (1).
    kinds = F.transform("_rest", lambda t: F.when(t.isin(corpora.PACKAGE_FLAGS), 2).when(F.startswith(t, F.lit("-")) | t.isin(corpora.SUBCOMMANDS), 0).otherwise(1))
    df = T.once(df, _runner=runner, _kinds=kinds, _module=F.when(c("_first").isin("python", "python3") & (c("_m") > 0), at(c("_tokens"), c("_m"))))
    df = T.once(df, _place=F.array_position(F.transform("_kinds", lambda k: k > 0), True))
    picked = F.when(c("_place") > 0, F.when(at(c("_kinds"), c("_place") - 1) == 2, at(c("_rest"), c("_place"))).otherwise(at(c("_rest"), c("_place") - 1)))
    df = T.once(df, _named=F.when(c("_runner").isNotNull(), picked).otherwise(c("_first")))
    elsewhere = F.contains("_named", F.lit("://")) | c("_named").rlike(r"^(git\+|\./|\.\./|/)") | (F.contains("_named", F.lit("/")) & ~F.startswith("_named", F.lit("@")))
    note = (
        F.when(F.size("_tokens") == 0, "error").when(c("_first").isin("node", "deno"), "unverifiable").when(c("_module").isNotNull(), None)
        .when(c("_first").isin("python", "python3"), "unverifiable").when(c("_named").isNull(), "error").when(elsewhere, "unverifiable")
    )
    df = T.once(df, note=note)
    found = c("note").isNull()
    ecosystem = F.when(found, F.when(c("_module").isNotNull(), "pypi").otherwise(F.coalesce("_runner", F.lit("npm"))))
    return df.select(*commands.columns, ecosystem.alias("ecosystem"), F.when(found, F.coalesce("_module", "_named")).alias("package"), "note")


def inspect_trust(verdict: Column, worst_rank: Column, resolved: Column) -> Column:
    """AVOID, REVIEW or GREEN from the package's verdict and the worst finding."""
    avoid = verdict.isin("MALICIOUS", "MISSING", "LOOKALIKE") | (worst_rank == 0)
    review = verdict.isin("SUSPICIOUS", "VULNERABLE") | ~resolved | (worst_rank == 1)
    return F.when(F.coalesce(avoid, F.lit(False)), "AVOID").when(F.coalesce(review, F.lit(False)), "REVIEW").otherwise("GREEN")


def inspect(
    commands: DataFrame, feeds: dict[str, DataFrame], now: Column, findings: DataFrame | None = None, allowed: DataFrame | None = None, fingerprints: DataFrame | None = None
) -> DataFrame:
    """``commands``: ``spec``.  ``findings``: ``spec, severity_rank`` of their manifests.

    ``allowed``: ``ecosystem, name, version``, pins that are OK.  ``fingerprints``: ``kind,
    fingerprint``; findings, which then have a ``fingerprint``, of a cleared manifest don't count.
    """
    c = resolve_commands(commands.select("spec"))
    pins = c.where("package is not null").select("ecosystem", names.spec_name(F.col("package")).alias("name"), names.spec_version(F.col("package")).alias("version")).distinct()
    reports = verify(pins, now=now, **feeds)
    if allowed is not None:
        reports = apply_allowlist(reports, allowed)
    reports = reports.select(
        F.col("ecosystem").alias("_e"), names.display_name(F.col("name"), F.col("version")).alias("_p"), "verdict", "reason"
    )
    out = c.join(reports, (F.col("ecosystem") == F.col("_e")) & (F.col("package") == F.col("_p")), "left").drop("_e", "_p")
    if findings is not None and fingerprints is not None:
        findings = allowlist.split_trusted(findings, fingerprints, "manifest")[1]
    if findings is None:
        out = out.withColumn("worst", F.lit(None).cast("int"))
    else:
        out = out.join(findings.groupBy("spec").agg(F.min("severity_rank").alias("worst")), "spec", "left")
    return out.withColumn("trust", inspect_trust(F.col("verdict"), F.col("worst"), F.col("package").isNotNull()))


# Provenance

def attestation_presence(attestations: Column) -> Column:
    """From the JSON of a version's attestations: an object with a URL is well formed, another object is malformed."""
    v = F.try_parse_json(attestations)
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    url = F.try_variant_get(v, "$.url", "string")
    return F.when(F.coalesce(is_object, F.lit(False)), F.when(F.coalesce(url, F.lit("")) != "", "WELL_FORMED").otherwise("MALFORMED")).otherwise("ABSENT")


def repo_matches(repo: Column, name: Column) -> Column:
    """Whether a repository names the package or its scope."""
    low, scope, bare = F.lower(repo), F.lower(F.regexp_extract(name, "^@([^/]+)/", 1)), names.base_name(name)
    return F.contains(low, bare) | ((scope != "") & F.contains(low, scope))


def provenance_rules() -> list[Column]:
    """Over ``verdict, presence, supported, source_repo, name``."""
    c = F.col
    ok = c("verdict") == "OK"
    bad_repo = c("source_repo").isNotNull() & ~repo_matches(c("source_repo"), c("name"))
    return [
        F.when(c("verdict").isin("MISSING", "MALICIOUS", "LOOKALIKE"), finding("HIGH", "registry", F.concat(F.lit("registry verdict "), c("verdict")), None, 0)),
        F.when(~c("supported"), finding("INFO", "provenance", "no attestations in this ecosystem", None, 1)),
        F.when(c("supported") & (c("presence") == "WELL_FORMED"), finding("INFO", "provenance", "attestation present, not verified", None, 2)),
        F.when(c("supported") & (c("presence") == "MALFORMED"), finding("MEDIUM", "provenance", "attestation malformed", None, 3)),
        F.when(c("supported") & (c("presence") == "ABSENT") & ok, finding("LOW", "provenance", "no attestation", None, 4)),
        F.when(bad_repo, finding("LOW", "source-repo", "repository doesn't name the package", c("source_repo"), 5)),
    ]


def provenance(reports: DataFrame, attested: DataFrame, keys: list[str]) -> DataFrame:
    """``attested``: ``ecosystem, name, presence, source_repo``.  Findings of verified packages."""
    eco = reports.sparkSession.createDataFrame([(e[0], e[3]) for e in corpora.ECOSYSTEMS], "ecosystem string, supported boolean")
    rows = reports.join(attested, ["ecosystem", "name"], "left").join(F.broadcast(eco), "ecosystem")
    rows = rows.withColumn("presence", F.coalesce("presence", F.lit("ABSENT")))
    return text_rules.scan_rules(rows, keys, provenance_rules(), F.col("name"))


# Predicted names

#: Predicted names that are verified, by default.
PREDICTED = 80
#: Names of a project whose variants are worked out in one row.
FEW_NAMES = 64


def directory() -> Column:
    """The folder of a ``path``, ``.`` for a bare name."""
    return F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("."))


def projects(project_files: DataFrame) -> DataFrame:
    """``directory, ecosystem, manifest, name, ord``: the dependencies in each folder's first manifest, by name; a manifest without any has one row without a name.

    ``project_files``: ``path, file_name, text``.
    """
    first = files.first_manifest(project_files.withColumn("directory", directory()))
    heads = first.select("directory", dependencies.ecosystem_of(F.col("file_name")).alias("ecosystem"), F.col("file_name").alias("manifest"))
    named = dependencies.manifest_names(first, "directory").select("directory", "name").distinct()
    place = F.row_number().over(Window.partitionBy("directory").orderBy("name")) - 1
    return heads.join(named.withColumn("ord", place), "directory", "left")


def _affixes(spark: SparkSession) -> DataFrame:
    """At most 22 rows an ecosystem: suffixes, then prefixes."""
    rows = [(e, i, *x) for e, (s, p) in corpora.AFFIXES.items() for i, x in enumerate([("", y) for y in s] + [(y, "") for y in p])]
    return F.broadcast(spark.createDataFrame(rows, "ecosystem string, affix_ord int, prefix string, suffix string"))


def predicted_names(existing: DataFrame, limit: int | None = None, key: str = "ecosystem") -> DataFrame:
    """``existing``: ``ecosystem, name, ord`` and the key.  Names that a model may make up around them: key, ``ecosystem, predicted, ord``.

    Seeds are the own dependencies in order, then well-known packages; each with
    every suffix, then every prefix.  With a ``limit``, only the first seeds of a key are
    expanded, and four times as many where these give too few names: of the existing
    names, only places and a look-up among the candidates depend on how many there are.
    """
    spark = existing.sparkSession
    keys = list(dict.fromkeys([key, "ecosystem"]))
    magnets = spark.createDataFrame([(e, n, i) for e, xs in corpora.MAGNETS.items() for i, n in enumerate(xs)], "ecosystem string, seed string, place long")
    own = existing.select(*keys, names.base_name(F.col("name")).alias("seed"), F.col("ord").cast("long").alias("place")).where("seed <> ''")
    known = existing.select(*keys).distinct().join(F.broadcast(magnets), "ecosystem").select(*keys, "seed", "place")
    taken = existing.select(*keys, F.lower("name").alias("predicted"))

    def fresh(own: DataFrame, known: DataFrame) -> DataFrame:
        """Candidates that aren't taken, at their first place, with their rank."""
        seeds = own.withColumn("group", F.lit(0)).unionByName(known.withColumn("group", F.lit(1)))
        seeds = seeds.groupBy(*keys, "seed").agg(F.min(F.struct("group", "place")).alias("at"))
        variants = seeds.join(_affixes(spark), "ecosystem").select(*keys, F.lower(F.concat("prefix", "seed", "suffix")).alias("predicted"), F.struct("at", "affix_ord").alias("at"))
        variants = variants.groupBy(*keys, "predicted").agg(F.min("at").alias("at"))
        sought = variants.select(*keys, "predicted")
        if limit is not None and key == "ecosystem":
            sought = F.broadcast(sought)  # three ecosystems, as many seeds as are expanded, 22 affixes
        met = taken.join(sought, [*keys, "predicted"], "left_semi").distinct()
        place = F.row_number().over(Window.partitionBy(key).orderBy("at", "predicted"))
        return variants.join(met, [*keys, "predicted"], "left_anti").withColumn("_rank", place)

    few_names = None
    if limit is not None and key != "ecosystem":
        few_names, existing = _predicted_in_rows(existing, limit, keys, magnets)
        own, known, taken = (x.join(existing.select(key).distinct(), key, "left_semi") for x in (own, known, taken))
        if existing.isEmpty():
            return few_names
    if limit is None:
        return fresh(own, known).select(*keys, "predicted", (F.col("_rank") - 1).alias("ord"))
    seeds = max(limit, 16)
    while True:
        order = Window.partitionBy(key).orderBy("place", "seed")
        first = own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= seeds + 1)
        more = first.where(F.col("_r") > seeds).select(key)
        found = fresh(first.where(F.col("_r") <= seeds).drop("_r"), known.join(more, key, "left_anti")).where(F.col("_rank") <= limit)
        few = more.join(found.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= limit), key, "left_anti")
        if more.isEmpty() or few.isEmpty():
            found = found.select(*keys, "predicted", (F.col("_rank") - 1).alias("ord"))
            return found if few_names is None else few_names.unionByName(found)
        seeds *= 4


def _predicted_in_rows(existing: DataFrame, limit: int, keys: list[str], magnets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``predicted_names`` of the keys with at most ``FEW_NAMES`` names, each worked out in one row, and the existing names of the other keys.

    What is shuffled are the existing names, not their many variants.
    """
    place = F.row_number().over(Window.partitionBy(keys[0]).orderBy("ord", "name"))
    # A few bytes of names become many rows, so tasks aren't joined by how little they read.
    spark = existing.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = existing.select(*keys, "name", F.col("ord").cast("long").alias("ord")).repartition(tasks, keys[0]).withColumn("_r", place).where(F.col("_r") <= FEW_NAMES + 1)
    seed = names.base_name(F.col("name"))
    own = F.when(seed != "", F.struct(F.lit(0).alias("group"), F.col("ord").alias("place"), seed.alias("seed")))
    per = rows.groupBy(keys[0], "ecosystem").agg(F.collect_list(own).alias("_own"), F.collect_list(F.lower("name")).alias("_taken"), F.max("_r").alias("_last"))
    per = per.withColumn("_last", F.max("_last").over(Window.partitionBy(keys[0])))
    # Three rows, one an ecosystem.
    known = magnets.groupBy("ecosystem").agg(F.collect_list(F.struct(F.lit(1).alias("group"), "place", "seed")).alias("_known"))
    affixes = _affixes(spark).groupBy("ecosystem").agg(F.collect_list(F.struct("affix_ord", "prefix", "suffix")).alias("_affixes"))
    met = per.where(F.col("_last") <= FEW_NAMES).join(F.broadcast(known), "ecosystem", "left").join(F.broadcast(affixes), "ecosystem")
    seeds = F.concat("_own", F.coalesce("_known", F.array().cast("array<struct<group:int,place:bigint,seed:string>>")))
    variant = lambda s, a: F.struct(s["group"].alias("group"), s["place"].alias("place"), a["affix_ord"].alias("affix_ord"), F.lower(F.concat(a["prefix"], s["seed"], a["suffix"])).alias("predicted"))
    variants = F.flatten(F.transform(seeds, lambda s: F.transform("_affixes", lambda a: variant(s, a))))
    # In order of their places; a name that comes again counts once, at its first, and one that is taken not at all.
    fresh = F.array_except(F.transform(F.sort_array(variants), lambda v: v["predicted"]), F.col("_taken"))
    made = met.select(*keys, fresh.alias("_fresh")).select(*keys, F.posexplode(F.slice("_fresh", 1, limit)).alias("ord", "predicted"))
    big = existing.groupBy(keys[0]).agg(F.count("*").alias("n")).where(F.col("n") > FEW_NAMES).select(keys[0])
    return made.select(*keys, "predicted", "ord"), existing.join(big, keys[0], "left_semi")


def fresh_squat(created: Column, downloads: Column, now: Column) -> Column:
    """At most a year old and hardly used; unknown use counts as little."""
    age = names.age_days(created, now)
    return F.coalesce(age <= TRAP_AGE_DAYS, F.lit(False)) & F.coalesce(downloads < TRAP_DOWNLOADS, F.lit(True))


def classify_predicted(reports: DataFrame, now: Column) -> DataFrame:
    """Adds ``guard`` (don't install) and ``trap`` (someone has planted it)."""
    v = F.col("verdict")
    planted = v.isin("MALICIOUS", "LOOKALIKE")
    trap = planted | (~v.isin("MISSING", "MALICIOUS", "LOOKALIKE") & fresh_squat(F.col("created"), F.col("downloads"), now))
    return reports.withColumn("trap", trap).withColumn("guard", (v == "MISSING") | trap)


def foresee(existing: DataFrame, feeds: dict[str, DataFrame], allowed: DataFrame, now: Column, limit: int = PREDICTED) -> DataFrame:
    """Reports of the predicted names with ``guard`` and ``trap``; at most ``limit`` an ecosystem.

    ``existing``: ``ecosystem, name, ord``.  ``allowed``: ``ecosystem, name, version``; a
    name that is allowed at its latest version is left out, whatever its verdict.
    """
    asked = predicted_names(existing, limit).select("ecosystem", F.col("predicted").alias("name"), "ord", F.lit(None).cast("string").alias("version"))
    cleared = allowed.select("ecosystem", "name", F.col("version").alias("latest_version"))
    reports = verify(asked, now=now, **feeds).join(cleared, ["ecosystem", "name", "latest_version"], "left_anti")
    return classify_predicted(reports, now)


def foresee_projects(found: DataFrame, feeds: dict[str, DataFrame], allowed: DataFrame, now: Column, limit: int = PREDICTED) -> DataFrame:
    """From manifests to guardrails: ``directory``, a report of each predicted name, ``ord, guard, trap``; at most ``limit`` a project.

    ``found``: as ``projects`` gives it.  Each name is verified once, however many projects it is predicted for.
    """
    asked = predicted_names(found, limit, "directory")
    reports = verify(asked.select("ecosystem", F.col("predicted").alias("name")).distinct().withColumn("version", F.lit(None).cast("string")), now=now, **feeds)
    cleared = allowed.select("ecosystem", "name", F.col("version").alias("latest_version"))
    reports = classify_predicted(reports.join(cleared, ["ecosystem", "name", "latest_version"], "left_anti"), now)
    return asked.withColumnRenamed("predicted", "name").join(reports, ["ecosystem", "name"])


def severity_of_trust(trust: Column) -> Column:
    return rank(trust, corpora.TRUSTS)
