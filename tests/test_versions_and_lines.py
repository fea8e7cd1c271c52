import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from cinderlake.functions import names
from cinderlake.operators import dependencies, lines, packages, surface
from cinderlake.sources import feeds

SEMVER = ["0.0.0-0", "0.0.0", "0.1", "0.9.10", "1-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0-rc.1.0", "1.0.0", "1.0.1", "1.2.0", "1.10", "2.0.0--", "2.0.0-a-b", "2", "12345678901234567890.0.1"]
PEP440 = [
    "0.1.dev1", "0.1a1.dev2", "0.1a1", "0.1b2", "0.1rc1.dev1", "0.1rc1", "0.1", "0.1+abc", "0.1+abc.7", "0.1+5", "0.1.post1.dev3", "0.1.post1", "0.1.1", "0.9", "0.10", "1.0.dev456", "1.0a1", "1.0a2.dev456",
    "1.0a12.dev456", "1.0a12", "1.0b1.dev456", "1.0b2", "1.0b2.post345.dev456", "1.0b2.post345", "1.0rc1.dev456", "1.0rc1", "1.0", "1.0+abc.5", "1.0+abc.7", "1.0+5", "1.0.post456.dev34", "1.0.post456", "1.1.dev1", "1!0.1",
]


def keys(spark, key, versions):
    df = spark.createDataFrame(list(enumerate(versions)), "i int, v string")
    return [r.k for r in df.select("i", key(F.col("v")).alias("k")).orderBy("i").collect()]


@pytest.mark.parametrize("key,ordered", [(names.semver_key, SEMVER), (names.pep440_key, PEP440)])
def test_keys_sort_as_versions_do(spark, key, ordered):
    found = keys(spark, key, ordered)
    assert None not in found and found == sorted(found) and len(set(found)) == len(found)


def test_spellings_of_one_version_and_of_none(spark):
    same = [("1.2", " v1.2.0 "), ("1.2.0+build.5", "1.2"), ("01.2", "1.2.0")]
    for a, b in same:
        assert len(set(keys(spark, names.semver_key, [a, b]))) == 1
    for a, b in [("1.0", "1"), ("1.0.0RC1", "1c1"), ("1.0-1", "1.0.post1"), ("1.0_alpha.2", "1a2"), ("v1.0.preview3", "1.0rc3"), ("1.0.rev4", "1.0post4"), ("0!1.dev", "1.0.dev0"), ("1.0+A-1", "1.0+a.1")]:
        assert len(set(keys(spark, names.pep440_key, [a, b]))) == 1, (a, b)
    assert keys(spark, names.semver_key, ["", "latest", "1.x", "1.2.3.4", "^1.0", "1.0-", None]) == [None] * 7
    assert keys(spark, names.pep440_key, ["", "latest", "1.x", "1..2", "1.0-rc-x", "^1", None]) == [None] * 7


def test_ranges_of_advisories(spark):
    events = [[("introduced", "1.0.0"), ("fixed", "1.2.0"), ("introduced", "2.0.0-rc.1"), ("last_affected", "2.1.0")], [("fixed", "1.0.0"), ("introduced", "0")], [("introduced", "3.0.0")], [("introduced", "1.0.0"), ("fixed", "1.0.0")], [("introduced", "odd")], []]
    vulns = [{"id": f"A{i}", "affected": [{"ranges": [{"type": "SEMVER", "events": [{k: v} for k, v in e]}]}]} for i, e in enumerate(events)]
    vulns += [{"id": "L", "affected": [{"versions": ["odd"], "ranges": []}]}, {"id": "ALL"}, {"id": "GIT", "affected": [{"ranges": [{"type": "GIT", "events": [{"introduced": "0"}]}]}]}, {"id": "W", "withdrawn": "x"}]
    bodies = spark.createDataFrame([("npm", "p", 200, json.dumps({"vulns": vulns}))], "ecosystem string, name string, status int, body string")
    asked = ["0.9.0", "1.0.0-rc.1", "1.0.0", "1.1.9", "1.2.0", "2.0.0-beta", "2.0.0-rc.1", "2.1.0", "2.1.1", "3.0.0-a", "3.0.0", "99.0.0", "odd", None]
    rows = spark.createDataFrame([("npm", "p", v, v) for v in asked], "ecosystem string, name string, version string, effective string")
    got = {r.version: [v.id for v in r.vulnerabilities] for r in packages.with_advisories(rows, feeds.advisories(bodies)).collect()}
    always = ["ALL", "GIT"]
    want = {"0.9.0": ["A1"], "1.0.0-rc.1": ["A1"], "1.0.0": ["A0"], "1.1.9": ["A0"], "1.2.0": [], "2.0.0-beta": [], "2.0.0-rc.1": ["A0"], "2.1.0": ["A0"], "2.1.1": [], "3.0.0-a": [], "3.0.0": ["A2"], "99.0.0": ["A2"], "odd": ["L"]}
    assert {v: sorted(x) for v, x in got.items() if v} == {v: sorted(x + always) for v, x in want.items()}
    assert len(got[None]) == len(vulns) - 1  # without a version, any


def test_candidates_of_lookalikes_are_few_and_hold_every_edit(spark):
    rng = random.Random(1)
    tops = [(e, n) for e, xs in packages.corpora.POPULAR.items() for n in xs]
    rows = []
    for _ in range(400):
        e, n = rng.choice(tops)
        i = rng.randrange(len(n))
        rows.append((e, rng.choice([n[:i] + n[i + 1 :], n[:i] + "z" + n[i:], n[:i] + "z" + n[i + 1 :], n[: i - 1] + n[i : i + 1] + n[i - 1 : i] + n[i + 1 :] if i else n, n.upper(), f"other-{i}-{n}"])))
    df = spark.createDataFrame(rows, "ecosystem string, name string").distinct()
    one = lambda a, b: a != b and (len(a) == len(b) and (sum(x != y for x, y in zip(a, b)) == 1 or any(a == b[:k] + b[k + 1] + b[k] + b[k + 2 :] for k in range(len(b) - 1))) or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1 :] == min(a, b, key=len) for k in range(max(len(a), len(b)))))
    want = {}
    known = set(tops)
    for e, n in set(rows) - known:
        near = [t for t in packages.corpora.POPULAR[e] if abs(len(t) - len(n)) <= 1 and (t == n.lower() or len(t) >= 4 and len(n) >= 4 and one(n.lower(), t))]
        if near:
            want[e, n] = next((t for t in near if t == n.lower()), near[0])
    assert {(r.ecosystem, r.name): r.lookalike for r in packages.lookalikes(df).collect()} == want
    assert len(want) > 100 and packages.lookalike_candidates(df).count() < 2 * df.count()


def test_running_values_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 5)
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, "x", "y"]), rng.randrange(3)) for k in ("a", "b", None) for i in range(rng.randint(1, 33))]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "k string, pos int, v string, n int")
    got = {(r.k, r.pos): (r.total, r.last) for r in lines.running(df, "k", {"total": F.col("n")}, {"last": F.col("v")}).collect()}
    for k, own in itertools.groupby(rows, key=lambda r: r[0]):
        total, last = 0, None
        for _, pos, v, n in own:
            total, last = total + n, v or last
            assert got[k, pos] == (total, last)


def test_long_files_are_dealt_over_tasks(spark):
    """Hundreds of thousands of lines of one file: the same rows, and no partition has them all."""
    n = 200_000
    jsonl = "\n".join(f'{{"i":{i}}}' if i % 7 else "  " for i in range(n))
    yarn = "\n".join(f'p{i}@^1:\n  version "{i}.0"\n  resolved "https://r/{i}"' for i in range(n // 4))
    df = spark.createDataFrame([("m.jsonl", jsonl)], "path string, text string")
    records = surface.memory_records(df)
    assert records.count() == n - len(range(0, n, 7))
    assert records.agg(F.max("record")).first()[0] == records.count() and records.where("record = 1").first().text == '{"i":1}'
    locked = dependencies.yarn_lock(spark.createDataFrame([("f", yarn)], "f string, text string"), "f")
    assert locked.count() == n // 4 and [tuple(r)[1:4] for r in locked.where(f"ord = {n // 4}").collect()] == [(n // 4, f"p{n // 4 - 1}", f"{n // 4 - 1}.0")]
    every = spark.createDataFrame([("f", "\n".join(map(str, range(n))))], "path string, text string").select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    spark.conf.set("spark.sql.adaptive.enabled", False)  # which would join small partitions again
    try:
        sizes = [r.n for r in lines.running(every, "path", {"s": F.lit(1)}).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.7 * n
