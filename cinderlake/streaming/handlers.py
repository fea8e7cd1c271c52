"""Answers to routed calls.

A handler takes the distinct calls of its tool (``call``, a digest, and ``line``, the
request) and returns ``call, result, is_error``; the operators run over all calls of a
batch at once.  Equal lines get equal answers.  A call whose arguments are missing or of
another kind, or name nothing here, and a tool without a handler, are results with
``isError``, not errors of the protocol.

Files that calls name by path or folder are tables of the server: ``path`` and ``text``.
A ``dir`` is ``.`` by default, which holds all files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import cards as card_rules
from ..operators import dependencies, drift, manifest, packages, surface, text_rules
from ..sources import logs, storage
from . import requests

Handler = Callable[[DataFrame], DataFrame]
FOUND = "array<struct<severity:string,category:string,tool:string,message:string,evidence:string>>"
CHANGES = "array<struct<severity:string,kind:string,tool:string,source:string,message:string,evidence:string>>"
#: A lock, as it is stored: a row of nulls says that it is there, a row without a name that a source is.
LOCKED = "lock string, path string, name string, description string, input_schema string, annotations string"
DEFAULT_LOCK = "mcp.lock"

# Other names of the ecosystems.
ALIASES = {
    "npm": ["npm", "node", "javascript", "js"],
    "pypi": ["pypi", "pip", "python", "py"],
    "crates": ["crates", "crates.io", "cargo", "rust"],
}


def _variant(key: str) -> Column:
    return F.try_variant_get(F.try_parse_json("line"), f"$.params.arguments.{key}", "variant")


def _typed(key: str, schema: str) -> Column:
    """Whether an argument is of this kind."""
    return F.coalesce(F.schema_of_variant(_variant(key)) == schema, F.lit(False))


def argument(key: str) -> Column:
    """An argument that is a string, else null."""
    return F.when(_typed(key, "STRING"), F.try_variant_get(_variant(key), "$", "string"))


def arguments(key: str) -> Column:
    """An argument that is a list of strings and has one, else null."""
    return F.when(_typed(key, "ARRAY<STRING>"), F.try_variant_get(_variant(key), "$", "array<string>"))


def number(key: str) -> Column:
    """An argument that is a whole number of at least 0, else null."""
    n = F.when(_typed(key, "BIGINT"), F.try_variant_get(_variant(key), "$", "bigint"))
    return F.when(n >= 0, n)


def ecosystem() -> Column:
    """The ecosystem of a call, npm where none is given; null for a name that is none."""
    given = F.lower(F.trim(argument("ecosystem")))
    out = F.when(given.isNull(), "npm")
    for name, others in ALIASES.items():
        out = out.when(given.isin(others), name)
    return out


def _answered(rows: DataFrame, result: Column) -> DataFrame:
    return rows.select("call", result.alias("result"), F.lit(False).alias("is_error"))


def _found(calls: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each call, worst first; a call without any has an empty list."""
    item = F.struct("severity", "category", "tool", "message", "evidence")
    order = F.struct("severity_rank", "check_ord", "phrase_ord", item.alias("f"))
    per = findings.groupBy("call").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["f"]).alias("findings"))
    rows = calls.join(per, "call", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FOUND)))
    return _answered(rows, F.to_json(F.struct(F.size("findings").alias("count"), "findings")))


def scan_content(calls: DataFrame) -> DataFrame:
    rows = calls.select("call", argument("content").alias("text"), F.lit("content").alias("label")).where("text is not null")
    return _found(rows.select("call"), text_rules.scan_text(rows, ["call"]))


def warden(files: DataFrame | None = None) -> Handler:
    """Findings of the tools of ``manifest``, else of the file at ``path``; a text that holds no tools is an error."""

    def handler(calls: DataFrame) -> DataFrame:
        rows = calls.select("call", argument("manifest").alias("text"), argument("path").alias("path"))
        given = rows.where("text is not null").select("call", "text")
        if files is not None:
            named = rows.where("text is null and path is not null").select("call", "path").join(files.select("path", "text"), "path")
            given = given.unionByName(named.select("call", "text"))
        unread = manifest.parse_tools(given, ["call"]).where("error").select("call")
        good = given.join(unread, "call", "left_anti")
        bad = unread.select("call", F.lit("the manifest has no tools, or isn't JSON").alias("result"), F.lit(True).alias("is_error"))
        return _found(good.select("call"), manifest.scan_manifests(good, "call")).unionByName(bad)

    return handler


def _listed(calls: DataFrame) -> DataFrame:
    """The packages that a call lists (``name`` or ``name@version``) of one ``ecosystem``."""
    rows = calls.select("call", ecosystem().alias("ecosystem"), F.posexplode(arguments("packages")).alias("place", "spec")).where("ecosystem is not null")
    return rows.withColumns({"name": names.spec_name(F.col("spec")), "version": names.spec_version(F.col("spec"))})


def _met(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that name packages, each beside what was ``found`` of it, if anything; a null version is a version of its own."""
    f = found.withColumnsRenamed({"ecosystem": "_e", "name": "_n", "version": "_v"})
    on = (F.col("ecosystem") == F.col("_e")) & (F.col("name") == F.col("_n")) & F.col("version").eqNullSafe(F.col("_v"))
    return rows.join(f, on, "left").drop("_e", "_n", "_v")


def _as_lists(rows: DataFrame, **lists: Column) -> DataFrame:
    """One result a call: lists of its items in order, without nulls."""
    per = rows.groupBy("call").agg(*[F.array_sort(F.collect_list(item)).alias(key) for key, item in lists.items()])
    return _answered(per, F.to_json(F.struct(*lists)))


def _once_for_all(calls: DataFrame, document: DataFrame) -> DataFrame:
    """A tool without arguments: its one-row ``result`` goes to every call."""
    asked = calls.select("call", F.lit(1).alias("_all"))
    return _answered(asked.join(F.broadcast(document.withColumn("_all", F.lit(1))), "_all"), F.col("result"))


def _summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``trust``, ``count`` and the findings by severity and category, a list that the rules bound, not the input."""
    per = findings.groupBy(*keys, "severity_rank", "severity", "category").agg(F.count("*").alias("n"))
    all_of = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("severity_rank", "category", "severity", "n"))).alias("_f"), F.min("severity_rank").alias("_worst"), F.sum("n").alias("count"))
    items = F.transform("_f", lambda x: F.struct(x["severity"].alias("severity"), x["category"].alias("category"), x["n"].alias("count")))
    return all_of.select(*keys, text_rules.trust_of(F.col("_worst")).alias("trust"), "count", items.alias("findings"))


def folders(path: Column) -> Column:
    """``.`` and every folder above a path."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))))


def _by_folder(calls: DataFrame, files: DataFrame, scan: Callable[[DataFrame], DataFrame], total: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Trust of all files below each call's ``dir``.  A file is scanned once, however many calls ask for it.

    ``scan`` gives findings with ``path``; ``total`` a row for each path with numbers to sum.
    """
    asked = calls.select("call", F.regexp_replace(F.coalesce(argument("dir"), F.lit(".")), "(?<=.)/+$", "").alias("dir"))
    dirs = asked.select("dir").distinct()
    inside = files.select("path", F.explode(folders(F.col("path"))).alias("dir")).distinct().join(dirs, "dir")
    wanted = files.join(inside.select("path").distinct(), "path", "left_semi")
    found = _summary(inside.join(scan(wanted), "path"), ["dir"])
    numbers = inside.join(total(wanted), "path")
    counted = [c for c in numbers.columns if c not in ("dir", "path")]
    numbers = numbers.groupBy("dir").agg(*[F.sum(c).alias(c) for c in counted])
    rows = asked.join(found, "dir", "left").join(numbers, "dir", "left")
    empty = F.array().cast("array<struct<severity:string,category:string,count:bigint>>")
    return _answered(
        rows,
        F.to_json(F.struct(F.coalesce("trust", F.lit("GREEN")).alias("trust"), F.coalesce("count", F.lit(0)).alias("count"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counted], F.coalesce("findings", empty).alias("findings"))),
    )


def verify(feeds: dict[str, DataFrame], now: Column) -> Handler:
    """Reports of ``packages``."""

    def handler(calls: DataFrame) -> DataFrame:
        rows = _listed(calls)
        reports = packages.verify(rows.select("ecosystem", "name", "version").distinct(), now=now, **feeds)
        met = _met(rows, reports.select("ecosystem", "name", "version", "verdict", "reason"))
        return _as_lists(met, reports=F.struct("place", "ecosystem", "name", "version", "verdict", "reason"))

    return handler


def provenance(feeds: dict[str, DataFrame], attested: DataFrame, now: Column) -> Handler:
    """Provenance findings of ``packages``; ``attested`` as in ``packages.provenance``."""

    def handler(calls: DataFrame) -> DataFrame:
        rows = _listed(calls)
        reports = packages.verify(rows.select("ecosystem", "name", "version").distinct(), now=now, **feeds)
        found = packages.provenance(reports.select("ecosystem", "name", "version", "verdict"), attested, ["ecosystem", "version"])
        met = _met(rows, found.select("ecosystem", F.col("tool").alias("name"), "version", "severity_rank", "severity", "category", "message"))
        item = F.struct("place", "severity_rank", "category", "ecosystem", "name", "version", "severity", "message")
        return _as_lists(met, findings=F.when(F.col("severity").isNotNull(), item))

    return handler


def verify_lockfile(files: DataFrame, feeds: dict[str, DataFrame], now: Column) -> Handler:
    """Reports of all pins of the lockfile at ``path``, and its integrity findings; ``files``: ``path, file_name, text``."""

    def handler(calls: DataFrame) -> DataFrame:
        asked = calls.select("call", argument("path").alias("path")).join(files.select("path").distinct(), "path", "left_semi")
        locked = dependencies.read_lockfiles(files.join(asked.select("path").distinct(), "path", "left_semi"), "path")
        pins = dependencies.package_refs(locked, "path")
        reports = packages.verify(pins.select("ecosystem", "name", "version").distinct(), now=now, **feeds)
        met = _met(asked.join(pins, "path", "left"), reports.select("ecosystem", "name", "version", "verdict", "reason"))
        met = met.select("call", F.when(F.col("name").isNotNull(), F.struct("ecosystem", "name", "version", "verdict", "reason")).alias("report"), F.lit(None).alias("finding"))
        found = asked.join(dependencies.integrity_findings(locked, ["path"]), "path")
        found = found.select("call", F.struct("severity_rank", "tool", "category", "severity", "message", "evidence").alias("finding"))
        return _as_lists(met.drop("finding").unionByName(found, allowMissingColumns=True), reports=F.col("report"), integrity=F.col("finding"))

    return handler


def cardcheck(cards: DataFrame) -> Handler:
    """Findings of the ``card`` given, or of that of ``target``, but not of both; ``cards``: ``target, card, served_host``."""

    def handler(calls: DataFrame) -> DataFrame:
        asked = calls.select("call", argument("target").alias("target"), argument("card").alias("text"))
        named = asked.where("target is not null and text is null").select("call", "target")
        known = cards.join(named.select("target").distinct(), "target", "left_semi").where("card is not null")
        rows = named.join(known.select("target").distinct(), "target", "left_semi")
        found = rows.join(card_rules.check_cards(known, "target"), "target")
        given = asked.where("text is not null and target is null").withColumn("served_host", F.lit(None).cast("string"))
        given = card_rules.parse_cards(given.select("call", "served_host", "text"), ["call", "served_host"]).where("card is not null")
        found = found.drop("target").unionByName(card_rules.check_cards(given, "call"), allowMissingColumns=True)
        return _found(rows.select("call").unionByName(given.select("call")), found)

    return handler


def memcheck(files: DataFrame) -> Handler:
    """Trust of the stored memories below ``dir``, and how many files and records there are; ``files``: ``path, text``."""
    return lambda calls: _by_folder(calls, files, surface.memcheck, surface.memory_totals)


def skillscan(files: DataFrame) -> Handler:
    """Trust of the skills below ``dir``, and how many files there are; ``files``: ``skill, path, kind, text``."""
    return lambda calls: _by_folder(calls, files, surface.skillscan, lambda x: x.select("path", F.lit(1).alias("files")).distinct())


def audit(configs: DataFrame, instructions: DataFrame) -> Handler:
    """Totals of the agent surface and what was found: servers, secrets, network hooks, settings.

    ``configs``: ``ord, source, text``; ``instructions``: ``source, text``.  Lists are those of a snapshot, distinct.
    """

    def handler(calls: DataFrame) -> DataFrame:
        parts = surface.audit(configs, instructions)
        kinds = surface.snapshot(parts).groupBy().agg(F.array_sort(F.collect_list(F.struct("kind", "value"))).alias("found"))
        document = surface.totals(parts).withColumn("_k", F.lit(1)).join(kinds.withColumn("_k", F.lit(1)), "_k").drop("_k")
        return _once_for_all(calls, document.select(F.to_json(F.struct(*document.columns)).alias("result")))

    return handler


def foresee(files: DataFrame, feeds: dict[str, DataFrame], allowed: DataFrame, now: Column) -> Handler:
    """Predicted names around the first dependency manifest in ``dir``, verified, at most ``limit`` (80); ``files``: ``path, file_name, text``."""

    def handler(calls: DataFrame) -> DataFrame:
        asked = calls.select("call", F.regexp_replace(F.coalesce(argument("dir"), F.lit(".")), "(?<=.)/+$", "").alias("directory"), F.coalesce(number("limit"), F.lit(packages.PREDICTED)).alias("limit"))
        projects = packages.projects(files.join(asked.select("directory").distinct(), packages.directory() == F.col("directory"), "left_semi"))
        most = asked.agg(F.max("limit")).first()[0]
        found = packages.foresee_projects(projects, feeds, allowed, now, most or 0)
        rows = asked.join(projects.select("directory", "ecosystem", "manifest").distinct(), "directory").join(found.drop("ecosystem"), "directory", "left").where(F.coalesce(F.col("ord") < F.col("limit"), F.lit(True)))
        item = F.when(F.col("name").isNotNull(), F.struct("ord", "name", "verdict", "reason", "guard", "trap"))
        per = rows.groupBy("call", "ecosystem", "manifest").agg(F.array_sort(F.collect_list(item)).alias("predicted"))
        return _answered(per, F.to_json(F.struct("ecosystem", "manifest", "predicted")))

    return handler


def inspect(feeds: dict[str, DataFrame], now: Column) -> Handler:
    """Verdict and trust of ``server``, a package or an install command."""

    def handler(calls: DataFrame) -> DataFrame:
        rows = calls.select("call", argument("server").alias("spec")).where("spec is not null")
        out = packages.inspect(rows.select("spec").distinct(), feeds, now)
        met = rows.join(out.select("spec", "ecosystem", "package", "verdict", "reason", "trust"), "spec")
        return _answered(met, F.to_json(F.struct(F.col("spec").alias("server"), "ecosystem", "package", "verdict", "reason", "trust")))

    return handler


# Locks

def _asked(calls: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls whose ``paths`` all are manifests (``call, lock``), the others with a reason, and the tools of the good ones (``call, path`` and a tool, or nulls for a source without any).

    Manifests are parsed once, dealt over all cores, and each of the three is made once: their readers are many.
    """
    rows = calls.select("call", F.coalesce(argument("lock"), F.lit(DEFAULT_LOCK)).alias("lock"), arguments("paths").alias("paths")).where("paths is not null")
    paths = storage.staged(rows.select("call", "lock", F.explode(F.array_distinct("paths")).alias("path")), "asked")
    wanted = files.join(paths.select("path").distinct(), "path", "left_semi").select("path", "text")
    wanted = wanted.repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "path")
    parsed = storage.staged(manifest.parse_tools(wanted, ["path"]), "tools")
    tools = drift.locked_tools(parsed.where("not error")).drop("error")
    known = parsed.groupBy("path").agg(F.bool_or("error").alias("error"))
    checked = paths.join(known, "path", "left").groupBy("call", "lock").agg(F.min(F.when(F.coalesce("error", F.lit(True)), F.col("path"))).alias("wrong"))
    checked = storage.staged(checked, "checked")
    good = checked.where("wrong is null").select("call", "lock")
    bad = checked.where("wrong is not null").select("call", F.concat(F.lit("no manifest at "), F.col("wrong")).alias("result"), F.lit(True).alias("is_error"))
    return good, bad, storage.staged(paths.join(good.select("call"), "call", "left_semi").join(tools, "path"), "met")


def locks(files: DataFrame, log: logs.Log, writer: str = "locks") -> Callable[[int], dict[str, Handler]]:
    """Handlers of ``lock`` and ``drift`` for a batch of a stream.  ``files``: ``path, text``, the manifests as they are now.

    The calls of a batch are answered at the version of the log (of ``LOCKED``) that the batch finds: its ``lock``
    calls make the next version in one commit, which its ``drift`` calls don't see.  A batch that comes again finds the
    same version and commits nothing.  Of several calls in one batch that write one lock, that of the greatest digest counts.
    """

    def of_batch(batch: int) -> dict[str, Handler]:
        def lock(calls: DataFrame) -> DataFrame:
            good, bad, tools = _asked(calls, files)
            winner = good.groupBy("lock").agg(F.max("call").alias("call"))
            columns = [c.split()[0] for c in LOCKED.split(", ")]
            rows = tools.join(winner, ["call", "lock"], "left_semi").select(*columns)
            there = winner.select("lock", *[F.lit(None).cast("string").alias(c) for c in columns[1:]])
            log.append(rows.unionByName(there), writer, batch)
            totals = tools.groupBy("call").agg(F.count_distinct("path").alias("sources"), F.count("name").alias("tools"))
            return _answered(good.join(totals, "call"), F.to_json(F.struct("lock", "sources", "tools"))).unionByName(bad)

        def drifted(calls: DataFrame) -> DataFrame:
            good, bad, tools = _asked(calls, files)
            held = logs.latest_of(log.rows(log.before(writer, batch)), ["lock"])
            known = good.join(held.select("lock").distinct(), "lock", "left_semi")
            unknown = good.join(held.select("lock").distinct(), "lock", "left_anti").select("call", F.concat(F.lit("no lock at "), F.col("lock"), F.lit("; run lock first")).alias("result"), F.lit(True).alias("is_error"))
            source = F.struct("call", F.col("path").alias("source")).alias("path")
            fields = ["name", "description", "input_schema", "annotations"]
            locked = storage.staged(known.join(held.where("path is not null"), "lock").select(source, *fields), "locked")
            current = storage.staged(tools.join(known.select("call"), "call", "left_semi").select(source, *fields), "current")
            changes = drift.drift(locked, current).select("path.call", "path.source", "severity_rank", "tool", "kind", "severity", "message", "evidence")
            per = changes.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("severity_rank", "source", "tool", "kind", "severity", "message", "evidence"))).alias("_c"))
            kept = F.transform("_c", lambda c: F.struct(*[c[x].alias(x) for x in ("severity", "kind", "tool", "source", "message", "evidence")]))
            rows = known.join(per, "call", "left").withColumn("changes", F.coalesce(kept, F.array().cast(CHANGES)))
            return _answered(rows, F.to_json(F.struct("lock", F.size("changes").alias("count"), "changes"))).unionByName(bad).unionByName(unknown)

        return {"lock": lock, "drift": drifted}

    return of_batch


#: Handlers that need no tables of the server.
TEXT_HANDLERS: dict[str, Handler] = {"scan_content": scan_content, "warden": warden()}


def answer(responded: DataFrame, handlers: dict[str, Handler], line: str = "value", asked_tools: set[str] | None = None) -> DataFrame:
    """The answer line of every routed call of ``requests.respond``.  ``asked_tools``: the tools that are called, if known; handlers of others don't run."""
    routed = responded.where("outcome = 'routed'").select("id", "tool", F.sha2(F.col(line), 256).alias("call"), F.col(line).alias("line"))
    asked = routed.select("tool", "call", "line").dropDuplicates(["call"])
    done = None
    for tool, handler in handlers.items():
        if asked_tools is None or tool in asked_tools:
            part = handler(asked.where(F.col("tool") == tool).select("call", "line"))
            done = part if done is None else done.unionByName(part)
    routed = routed.drop("line")
    rows = routed.withColumns({"result": F.lit(None).cast("string"), "is_error": F.lit(True)}) if done is None else routed.join(done, "call", "left")
    why = F.when(F.col("tool").isin(list(handlers)), "an argument is missing, or names nothing here").otherwise("this server has no such handler")
    content = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("result", why).alias("text")))
    head = F.struct(
        F.lit("2.0").alias("jsonrpc"), F.parse_json(F.coalesce("id", F.lit("null"))).alias("id"), F.struct(content.alias("content"), F.coalesce("is_error", F.lit(True)).alias("isError")).alias("result")
    )
    return rows.select(F.to_json(head).alias("value"))


def answer_batch(lines: DataFrame, number: int, out: str, handlers: dict[str, Handler] | Callable[[int], dict[str, Handler]]) -> None:
    """Answers one batch in a folder of its own, which a batch that comes again overwrites.  Its lines are parsed once."""
    rows = requests.respond(lines).persist()
    try:
        tools = {r["tool"] for r in rows.where("outcome = 'routed'").select("tool").distinct().collect()}  # names of the catalogue
        known = handlers(number) if callable(handlers) else handlers
        requests.answers(rows).unionByName(answer(rows, known, asked_tools=tools)).write.mode("overwrite").text(f"{out}/batch={number}")
    finally:
        rows.unpersist()


def serve(spark, folder: str, out: str, checkpoint: str, handlers: dict[str, Handler] | Callable[[int], dict[str, Handler]], available_now: bool = True):
    """All answers to the lines of ``folder``.  ``handlers``: by tool, or a function that gives them for the number of a batch."""

    def batch(lines: DataFrame, number: int) -> None:
        answer_batch(lines, number, out, handlers)

    writer = requests.read_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
