import datetime

import pytest
from pyspark.sql import functions as F

from cinderlake.sources import feeds, logs, storage


def rows(spark, *found):
    return spark.createDataFrame(list(found), "k string, v int")


def values(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_versions_stay_readable(spark, tmp_path):
    log = logs.Log(spark, f"file://{tmp_path}/log", "k string, v int")
    assert log.latest() == 0 and log.rows().collect() == []
    assert log.append(rows(spark, ("a", 1), ("b", 1))) == 1
    first = log.rows()
    assert log.append(rows(spark, ("a", 2))) == 2 and log.append(rows(spark)) == 3
    assert values(first) == values(log.rows(1)) == [("a", 1), ("b", 1)]
    assert values(logs.latest_of(log.rows(), ["k"])) == [("a", 2), ("b", 1)]
    assert log.compact(lambda df: logs.latest_of(df, ["k"])) == 4
    assert values(log.rows()) == [("a", 2), ("b", 1)] and values(log.rows(2)) == [("a", 1), ("a", 2), ("b", 1)]
    assert {(r.k, r.generation) for r in log.rows().collect()} == {("a", 2), ("b", 1)}
    log.expire(4)
    assert log.versions() == [4] and len(storage.names(spark, f"file://{tmp_path}/log/rows")) == 1 and values(log.rows()) == [("a", 2), ("b", 1)]


def test_a_crash_between_rows_and_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    log = logs.Log(spark, f"file://{tmp_path}/log", "k string, v int")
    log.append(rows(spark, ("a", 1)), "w", 0)

    def crash(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(storage, "publish", crash)
        with pytest.raises(OSError):
            log.append(rows(spark, ("a", 2)), "w", 1)
        with pytest.raises(OSError):
            log.compact(lambda df: df.limit(0))
    assert log.latest() == 1 and values(log.rows()) == [("a", 1)] and log.before("w", 1) == 1
    assert log.append(rows(spark, ("a", 2)), "w", 1) == 2
    assert log.append(rows(spark, ("a", 3)), "w", 1) == 2 and values(log.rows()) == [("a", 1), ("a", 2)]
    assert log.before("w", 1) == 1 and log.before("w", 0) == 0 and log.before("other", 0) == 2


def test_two_writers_of_one_version(spark, tmp_path):
    log = logs.Log(spark, f"file://{tmp_path}/log", "k string, v int")
    log.append(rows(spark, ("a", 1)))
    with pytest.raises(Exception, match="exists"):
        storage.publish(spark, f"file://{tmp_path}/log/versions/00000001.json", "{}")
    assert log.manifest()["version"] == 1


T0 = datetime.datetime(2026, 1, 1, 12)


def later(seconds):
    return F.lit(T0 + datetime.timedelta(seconds=seconds))


def test_misses_are_fetched_once(spark, tmp_path):
    cache, asked = feeds.ResponseCache(spark, f"file://{tmp_path}/cache", ttl=100), []
    status = {"ok": 200, "none": 404, "down": 500, "lost": None}

    def fetcher(missing):
        found = [(r.method, r.url, r.body_match) for r in missing.collect()]
        asked.extend(found)
        answers = [(m, u, b, status[u], f"{u}{len(asked)}" if status[u] else None, None if status[u] else "no route") for m, u, b in found]
        return spark.createDataFrame(answers, feeds.FETCHED)

    requests = spark.createDataFrame([("GET", "ok", None), ("GET", "ok", ""), ("POST", "ok", "q"), ("GET", "none", None), ("GET", "down", None), ("GET", "lost", None)], "method string, url string, body_match string")
    got = {(r.method, r.url, r.body_match): (r.status, r.error) for r in cache.fetch(requests, later(0), fetcher).collect()}
    assert got == {("GET", "ok", ""): (200, None), ("POST", "ok", "q"): (200, None), ("GET", "none", ""): (404, None), ("GET", "down", ""): (500, None), ("GET", "lost", ""): (None, "no route")}
    assert len(asked) == 5 and {r.status for r in cache.log.rows().collect()} == {200, 404}
    asked.clear()
    again = cache.fetch(requests, later(100), fetcher)
    assert again.count() == 5 and sorted(u for _, u, _ in asked) == ["down", "lost"]  # what failed isn't kept
    asked.clear()
    assert cache.fetch(requests, later(101), fetcher).count() == 5 and len(asked) == 5
    asked.clear()
    assert cache.fetch(requests, later(-1), fetcher).count() == 5 and len(asked) == 5  # answers from the future aren't served
    before = {tuple(r) for r in cache.fresh(later(101)).collect()}
    cache.compact()
    assert {tuple(r) for r in cache.fresh(later(101)).collect()} == before and len(before) == 3
    assert cache.log.rows().count() == 3
    assert cache.fetch(requests.limit(0), later(0), fetcher).collect() == []


def test_compaction_keeps_what_is_served_now(spark, tmp_path):
    """A newer response that is still in the future replaces the older one only once its time has come."""
    at = lambda s: F.timestamp_seconds(F.lit(1_000_000 + s))
    cache = feeds.ResponseCache(spark, f"file://{tmp_path}/cache", ttl=100)
    rows = spark.createDataFrame([("old", -20), ("served", -10), ("soon", 5), ("later", 9)], "body string, s int")
    cache.record(rows.select(F.lit("GET").alias("method"), F.lit("u").alias("url"), F.lit("").alias("body_match"), F.lit(200).alias("status"), "body", F.timestamp_seconds(F.col("s") + 1_000_000).alias("fetched_at")))
    cache.compact(at(0))
    assert cache.log.rows().count() == 3
    assert [cache.fresh(at(s)).first().body for s in (0, 4, 5, 8, 9)] == ["served", "served", "soon", "soon", "later"]


def test_requests_are_fetched_in_tasks(spark):
    asked = spark.createDataFrame([("GET", "http://127.0.0.1:9/x", None), ("GET", "nonsense", None)], "method string, url string, body_match string")
    got = {r.url: (r.status, bool(r.error)) for r in feeds.fetched(asked, total=2).collect()}
    assert got == {"http://127.0.0.1:9/x": (None, True), "nonsense": (None, True)}


def test_parts_are_joined_into_one_file(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two é")
    for _ in range(2):
        storage.concatenated(spark, f"file://{tmp_path}/all", ["<", (f"file://{tmp_path}/a",), ",", (f"file://{tmp_path}/b",), ">"])
    assert (tmp_path / "all").read_text() == "<one,two é>" and storage.read_text(spark, f"file://{tmp_path}/all") == "<one,two é>"
    assert [n for n in storage.names(spark, f"file://{tmp_path}") if n.startswith(".tmp")] == []
