"""Registry feeds: response tables, their readers, and a data source for live feeds.

A response is a row ``method, url, status, body, fetched_at``.  The default is a
snapshot in Parquet; ``HttpFeed`` reads URLs in tasks.  All parsers are native.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import names
from . import logs

TTL_SECONDS = 21_600
MAX_BODY = 64 << 20
RESPONSE = "method string, url string, body_match string, status int, body string, fetched_at timestamp"


class HttpFeed(DataSource):
    """``spark.read.format("http_feed").option("urls", "u1\\nu2").load()``: one row per URL.

    ``option("requests", ...)`` takes JSON lines ``{"method", "url", "body"}`` instead, for POST; a POST sends JSON.
    ``connect_timeout`` bounds a connection, ``timeout`` the whole request.  A status is data; only a transport failure is an error, in ``error``.  A body
    above the limit is an error, never cut.
    """

    @classmethod
    def name(cls) -> str:
        return "http_feed"

    def schema(self) -> str:
        return "url string, status int, body string, error string, method string, body_match string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options):
        lines = [json.loads(x) for x in options.get("requests", "").split("\n") if x.strip()]
        self.asked = [(r.get("method", "GET"), r["url"], r.get("body")) for r in lines] + [("GET", u, None) for u in options.get("urls", "").split("\n") if u]
        self.parts = max(1, min(int(options.get("partitions", "8")), len(self.asked) or 1))
        self.connect, self.total = float(options.get("connect_timeout", "10")), float(options.get("timeout", "30"))
        self.limit = int(options.get("max_body", str(MAX_BODY)))

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        for method, url, body in self.asked[partition.value :: self.parts]:
            try:
                status, data = fetch(method, url, body, self.connect, self.total, self.limit)
                error = "body above the limit" if len(data) > self.limit else None
            except (OSError, ValueError, http.client.HTTPException) as e:
                status, data, error = None, b"", str(e) or type(e).__name__
            text = None if error else data.decode("utf-8", "replace")
            yield (url, None if error else status, text, error, method, body or "")


def fetch(method: str, url: str, body: str | None, connect: float, total: float, limit: int) -> tuple[int, bytes]:
    """Status and at most ``limit + 1`` bytes, within ``total`` seconds in all."""
    end = time.monotonic() + total

    def left() -> float:
        rest = end - time.monotonic()
        if rest <= 0:
            raise TimeoutError("request timed out")
        return rest

    def bounded(kind):
        class Connection(kind):
            def connect(self):
                self.timeout = min(connect, left())
                super().connect()
                self.sock.settimeout(left())

        return Connection

    class Http(urllib.request.HTTPHandler):
        def http_open(self, req):
            return self.do_open(bounded(http.client.HTTPConnection), req)

    class Https(urllib.request.HTTPSHandler):
        def https_open(self, req):
            return self.do_open(bounded(http.client.HTTPSConnection), req)

    data = None if body is None else body.encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"} if data is not None else {}, method=method)
    try:
        answer = urllib.request.build_opener(Http, Https).open(request, timeout=left())
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        parts, size = [], 0
        while size <= limit:
            left()
            part = answer.read1(min(1 << 16, limit + 1 - size))
            if not part:
                break
            parts.append(part)
            size += len(part)
        return answer.status, b"".join(parts)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpFeed)


def fresh(responses: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """The latest response of each request that is 0 to ``ttl`` seconds old.  Only successes and 404 are kept."""
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    ok = (F.col("status").between(200, 299) | (F.col("status") == 404)) & age.between(0, ttl)
    place = F.row_number().over(Window.partitionBy("method", "url", "body_match").orderBy(F.col("fetched_at").desc(), "status", "body"))
    return responses.where(ok).withColumn("_p", place).where("_p = 1").drop("_p")


def misses(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Requests (``method, url`` and, for a POST, ``body_match``) that have to be fetched."""
    body = F.coalesce("body_match", F.lit("")) if "body_match" in requests.columns else F.lit("")
    have = cached.select(F.col("method").alias("_m"), F.col("url").alias("_u"), F.coalesce("body_match", F.lit("")).alias("_b")).distinct()
    asked = requests.withColumn("_body", body)
    on = (F.col("method") == F.col("_m")) & (F.col("url") == F.col("_u")) & (F.col("_body") == F.col("_b"))
    return asked.join(have, on, "left_anti").drop("_body")


KEPT = "status between 200 and 299 or status = 404"
FETCHED = "method string, url string, body_match string, status int, body string, error string"


def fetched(requests: DataFrame, connect: float = 10, total: float = 30, limit: int = MAX_BODY) -> DataFrame:
    """Answers to requests (``method, url, body_match``), fetched in tasks; a transport failure has no status but an ``error``."""

    def run(batches):
        for batch in batches:
            rows = []
            for method, url, body in zip(batch["method"], batch["url"], batch["body_match"]):
                try:
                    status, data = fetch(method, url, body or None, connect, total, limit)
                    error = "body above the limit" if len(data) > limit else None
                except (OSError, ValueError, http.client.HTTPException) as e:
                    status, data, error = None, b"", str(e) or type(e).__name__
                rows.append((method, url, body, None if error else status, None if error else data.decode("utf-8", "replace"), error))
            frame = pd.DataFrame(rows, columns=["method", "url", "body_match", "status", "body", "error"])
            yield frame.astype({"status": "Int32"})

    return requests.select("method", "url", "body_match").mapInPandas(run, FETCHED)


class ResponseCache:
    """Responses that are fetched once and kept, as a log of generations (``logs.Log``) in ``folder``.

    Only successes and 404 are kept.  A response is served while it is 0 to ``ttl`` seconds old at the time of asking,
    the newest of its request first; one from the future isn't served.  Every version of the log can be read as of any time.
    """

    def __init__(self, spark: SparkSession, folder: str, ttl: int = TTL_SECONDS):
        self.spark, self.folder, self.ttl = spark, folder, ttl
        self.log = logs.Log(spark, f"{folder}/log", RESPONSE)

    def record(self, responses: DataFrame) -> int:
        """A generation of responses; returns its version."""
        return self.log.append(responses.where(KEPT).withColumn("body_match", F.coalesce("body_match", F.lit(""))))

    def fresh(self, now: Column, version: int | None = None) -> DataFrame:
        return fresh(self.log.rows(version), now, self.ttl).drop("generation")

    def compact(self, now: Column | None = None) -> int:
        """Of each request, the newest response that isn't from the future stays, and all that are.

        At ``now`` (by default the time of the call) and later, the log serves what it served before; earlier times need an earlier version.
        """
        later = F.coalesce(F.unix_timestamp("fetched_at") > F.unix_timestamp(F.current_timestamp() if now is None else now), F.lit(False))
        place = F.row_number().over(Window.partitionBy("method", "url", "body_match").orderBy(F.col("fetched_at").desc(), "status", "body", "generation"))
        return self.log.compact(lambda rows: rows.where(~later).withColumn("_p", place).where("_p = 1").drop("_p").unionByName(rows.where(later)))

    def fetch(self, requests: DataFrame, now: Column, fetcher: Callable[[DataFrame], DataFrame] = fetched) -> DataFrame:
        """``method, url, body_match, status, body, error`` of each distinct request (``method, url, body_match``).

        What the log can't serve is fetched, written down whole, and then kept as the next generation; a crash in
        between costs the fetches since the last commit, and no response that was kept before.
        """
        key = ["method", "url", "body_match"]
        asked = requests.select("method", "url", F.coalesce("body_match", F.lit("")).alias("body_match")).distinct()
        served = self.fresh(now)
        new = fetcher(misses(asked, served))
        path = f"{self.folder}/fetched/{uuid.uuid4().hex}"
        new.select(*key, "status", "body", "error", now.cast("timestamp").alias("fetched_at")).write.parquet(path)
        new = self.spark.read.parquet(path)
        if not new.where(KEPT).isEmpty():
            self.record(new)
        known = served.join(asked, key, "left_semi").select(*key, "status", "body", F.lit(None).cast("string").alias("error"))
        return known.unionByName(new.select(*known.columns))


def npm_url(name: Column) -> Column:
    return F.concat(F.lit("https://registry.npmjs.org/"), names.slash_encoded(name))


def npm_metadata(bodies: DataFrame) -> DataFrame:
    """``name, status, body`` to metadata.  ``time`` holds objects beside strings; only a string is a creation time."""
    v = F.try_parse_json("body")
    at = lambda p, t="string": F.try_variant_get(v, p, t)
    created = at("$.time.created", "variant")
    return bodies.where("status between 200 and 299").select(
        F.lit("npm").alias("ecosystem"), "name", at("$['dist-tags'].latest").alias("latest_version"),
        F.when(F.schema_of_variant(created) == "STRING", at("$.time.created")).alias("created"),
        F.array_sort(F.coalesce(F.map_keys(F.from_json("body", "versions MAP<STRING, STRING>")["versions"]), F.array().cast("array<string>"))).alias("versions"),
    )


def npm_downloads(bodies: DataFrame) -> DataFrame:
    return bodies.select(
        F.lit("npm").alias("ecosystem"), "name", F.lit(None).cast("string").alias("created"), F.lit(None).cast("string").alias("latest_version"),
        F.when(F.col("status").between(200, 299), F.get_json_object("body", "$.downloads").cast("long")).alias("downloads"), F.lit("weekly").alias("downloads_window"),
    )


def npm_provenance(bodies: DataFrame, version: Column | None = None) -> DataFrame:
    """``ecosystem, name, version, attestations, signatures, source_repo`` of the pinned or latest version."""
    parsed = F.from_json("body", "`dist-tags` STRUCT<latest: STRING>, versions MAP<STRING, STRING>, repository STRING")
    rows = bodies.where("status between 200 and 299").withColumn("_p", parsed)
    chosen = F.coalesce(version if version is not None else F.lit(None).cast("string"), F.col("_p")["dist-tags"]["latest"])
    rows = rows.withColumn("version", chosen).withColumn("_v", F.col("_p.versions")[F.col("version")])
    url = lambda c: F.nullif(F.coalesce(F.get_json_object(c, "$.url"), F.when(~F.startswith(c, F.lit("{")), F.trim(c, F.lit('"')))), F.lit(""))
    return rows.select(
        F.lit("npm").alias("ecosystem"), "name", "version", F.get_json_object("_v", "$.dist.attestations").alias("attestations"),
        F.coalesce(F.size(F.from_json(F.get_json_object("_v", "$.dist.signatures"), "array<string>")) > 0, F.lit(False)).alias("signed"),
        F.coalesce(url(F.get_json_object("_v", "$.repository")), url(F.col("_p.repository"))).alias("source_repo"),
    )


PYPI = "info STRUCT<version: STRING, home_page: STRING, project_urls: MAP<STRING, STRING>>, releases MAP<STRING, ARRAY<STRUCT<upload_time_iso_8601: STRING, provenance: STRING>>>"


def pypi_metadata(bodies: DataFrame) -> DataFrame:
    """Created at the earliest upload of any file."""
    rows = bodies.where("status between 200 and 299").withColumn("_p", F.from_json("body", PYPI))
    uploads = F.transform(F.flatten(F.map_values("_p.releases")), lambda f: f["upload_time_iso_8601"])
    return rows.select(
        F.lit("pypi").alias("ecosystem"), "name", F.col("_p.info.version").alias("latest_version"), F.array_min(F.array_compact(uploads)).alias("created"),
        F.array_sort(F.coalesce(F.map_keys("_p.releases"), F.array().cast("array<string>"))).alias("versions"),
    )


def pypi_provenance(bodies: DataFrame, version: Column | None = None) -> DataFrame:
    rows = bodies.where("status between 200 and 299").withColumn("_p", F.from_json("body", PYPI))
    chosen = F.coalesce(version if version is not None else F.lit(None).cast("string"), F.col("_p.info.version"))
    rows = rows.withColumn("version", chosen).withColumn("_f", F.coalesce(F.col("_p.releases")[F.col("version")], F.array().cast("array<struct<upload_time_iso_8601:string,provenance:string>>")))
    well = F.exists("_f", lambda f: F.coalesce(F.trim(f["provenance"]), F.lit("")) != "")
    links = F.array_sort(F.filter(F.map_entries("_p.info.project_urls"), lambda e: F.lower(e["key"]).rlike("source|repository|github")))
    return rows.select(
        F.lit("pypi").alias("ecosystem"), "name", "version", F.when(well, "WELL_FORMED").otherwise("ABSENT").alias("presence"),
        F.nullif(F.coalesce(F.get(links, F.lit(0))["value"], F.col("_p.info.home_page")), F.lit("")).alias("source_repo"),
    )


def crates_metadata(bodies: DataFrame) -> DataFrame:
    """The index: a JSON object per line."""
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    return bodies.where("status between 200 and 299").select(
        F.lit("crates").alias("ecosystem"), "name", F.lit(None).cast("string").alias("latest_version"), F.lit(None).cast("string").alias("created"),
        F.transform(lines, lambda x: F.get_json_object(x, "$.vers")).alias("versions"),
    )


def crates_reputation(bodies: DataFrame) -> DataFrame:
    c = F.from_json("body", "crate STRUCT<created_at: STRING, max_stable_version: STRING, newest_version: STRING, max_version: STRING, recent_downloads: BIGINT, downloads: BIGINT>")["crate"]
    ok = F.col("status").between(200, 299)
    rows = bodies.withColumn("_c", F.when(ok, c))
    return rows.select(
        F.lit("crates").alias("ecosystem"), "name", F.col("_c.created_at").alias("created"),
        F.coalesce("_c.max_stable_version", "_c.newest_version", "_c.max_version").alias("latest_version"), F.coalesce("_c.recent_downloads", "_c.downloads").alias("downloads"), F.lit("90-day").alias("downloads_window"),
    )


RANGES = "array<struct<low:string,high:string,closed:boolean>>"


def version_ranges(ecosystem: Column, events: Column) -> Column:
    """Intervals of version keys from an advisory's events, each with ``introduced``, ``fixed`` or ``last_affected``.

    An interval begins at a version that is introduced (``0``: the lowest of all) and ends below the next one
    that is fixed, or with the next one that is the last affected; without either it is open.
    """
    key = lambda v: F.when(v == "0", "").otherwise(names.version_key(ecosystem, v))
    ends = F.transform(events, lambda e: F.struct(key(F.coalesce(e["fixed"], e["last_affected"])).alias("high"), e["fixed"].isNull().alias("closed")))
    ends = F.filter(ends, lambda e: e["high"].isNotNull())
    starts = F.filter(F.transform(events, lambda e: key(e["introduced"])), lambda low: low.isNotNull())

    # One that is fixed where it was introduced is empty.
    met = F.transform(starts, lambda low: F.struct(low.alias("low"), F.array_min(F.filter(ends, lambda e: e["high"] >= low)).alias("end")))
    return F.transform(met, lambda m: F.struct(m["low"].alias("low"), m["end"]["high"].alias("high"), F.coalesce(m["end"]["closed"], F.lit(False)).alias("closed"))).cast(RANGES)


def advisories(bodies: DataFrame) -> DataFrame:
    """``ecosystem, name, status, body`` of advisory answers, one row per advisory.

    ``affected``: the versions that an advisory lists, null where it lists none; ``ranges``: its
    intervals of version keys, null where it has none.  An advisory with neither stands for all versions.
    """
    event = "events: ARRAY<STRUCT<introduced: STRING, fixed: STRING, last_affected: STRING>>"
    vulns = F.from_json("body", f"vulns ARRAY<STRUCT<id: STRING, summary: STRING, withdrawn: STRING, database_specific: STRUCT<severity: STRING>, affected: ARRAY<STRUCT<versions: ARRAY<STRING>, ranges: ARRAY<STRUCT<type: STRING, {event}>>>>>>")["vulns"]
    rows = bodies.where("status between 200 and 299").select("ecosystem", "name", F.explode(vulns).alias("v"))
    listed = F.flatten(F.transform("v.affected", lambda a: F.coalesce(a["versions"], F.array().cast("array<string>"))))
    given = F.filter(F.flatten(F.transform("v.affected", lambda a: F.coalesce(a["ranges"], F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>")))), lambda r: r["type"].isin("SEMVER", "ECOSYSTEM"))
    ranges = F.flatten(F.transform(given, lambda r: version_ranges(F.col("ecosystem"), r["events"])))
    return rows.select(
        "ecosystem", "name", "v.id", "v.summary", F.upper("v.database_specific.severity").alias("severity"), "v.withdrawn", F.when(F.size(listed) > 0, listed).alias("affected"), F.when(F.size(given) > 0, ranges).alias("ranges")
    )


def malicious_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.startswith("id", F.lit("MAL-")) & F.col("withdrawn").isNull())


def by_ecosystem(*parts: DataFrame) -> DataFrame:
    """One feed of several ecosystems' rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
