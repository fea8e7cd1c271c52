import datetime
import json
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderlake.functions import hashing, jsontree, names
from cinderlake.operators import allowlist, dependencies, manifest, packages, surface
from cinderlake.plans import dependency_queries, package_queries
from cinderlake.sources import feeds

def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def column(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def signals(spark, **changes):
    row = {"exists": True, "published": None, "malicious_ids": [], "malicious_summary": None, "lookalike": None, "vulnerabilities": [], "created": "2020-01-01T00:00:00Z", "latest_version": "1.0", "downloads": 5000, "downloads_window": "weekly"} | changes
    schema = "exists boolean, published boolean, malicious_ids array<string>, malicious_summary string, lookalike string, vulnerabilities array<struct<id:string,severity:string>>, created string, latest_version string, downloads long, downloads_window string"
    r = packages.verdict_ladder(spark.createDataFrame([tuple(row.values())], schema), now()).first()
    return r.verdict, r.reason


def test_ladder_precedence(spark):
    everything = {"exists": False, "malicious_ids": ["MAL-1"], "lookalike": "x", "vulnerabilities": [("A", "HIGH")], "downloads": 1}
    assert signals(spark, **everything)[0] == "MALICIOUS"
    assert signals(spark, **(everything | {"malicious_ids": []}))[0] == "MISSING"
    assert signals(spark, published=False, lookalike="x")[0] == "MISSING"
    assert signals(spark, lookalike="x", vulnerabilities=[("A", None)])[0] == "LOOKALIKE"
    assert signals(spark, vulnerabilities=[("A", None), ("B", "LOW"), ("C", "CRITICAL"), ("D", None)], downloads=1) == ("VULNERABLE", "4 advisories, highest CRITICAL: A, B, C and 1 more")
    assert signals(spark, created="2024-05-20T00:00:00Z", downloads=5) == ("SUSPICIOUS", "created 12 days ago; only 5 weekly downloads")
    assert signals(spark, created="2024-06-09T00:00:00Z")[0] == "SUSPICIOUS"
    assert signals(spark, created="never", downloads=None)[0] == "OK"
    assert signals(spark) == ("OK", "latest 1.0, 5000 weekly downloads")
    assert signals(spark, latest_version=None, downloads=None)[1] == "exists, nothing against it"


def test_age_counts_whole_days(spark):
    got = column(spark, lambda x: names.age_days(x, now()), "2024-05-25T12:00:00Z", "2024-06-01T00:00:01Z", "bad", None)
    assert got == [6, 0, None, None]


def osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_one_edit(spark):
    pairs = [("axios", "aixos"), ("express", "expresss"), ("requests", "reqeusts"), ("tokio", "tokoi"), ("same", "same"), ("abcd", "badc"), ("a", "b"), ("", "a"), ("ab", "ba"), ("lodash", "lodahs1")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(names.one_edit(F.col("a"), F.col("b"))).collect()]
    assert got == [osa(a, b) == 1 for a, b in pairs]


def test_lookalikes(spark):
    rows = [("npm", "expresss"), ("npm", "express"), ("npm", "ехpress"), ("pypi", "reqeusts"), ("npm", "reqeusts"), ("crates", "ｔokio"), ("npm", "ab"), ("npm", "EXPRES")]
    got = {(r.ecosystem, r.name): r.lookalike for r in packages.lookalikes(spark.createDataFrame(rows, "ecosystem string, name string")).collect()}
    assert got == {("npm", "expresss"): "express", ("npm", "ехpress"): "express", ("pypi", "reqeusts"): "requests", ("crates", "ｔokio"): "tokio", ("npm", "EXPRES"): "express"}


def test_specs(spark):
    got = column(spark, lambda x: F.struct(names.spec_valid(x), names.spec_name(x), names.spec_version(x)), "a", "@s/a", "@s/a@1", "a@1@2", "a@", "")
    assert [tuple(g) for g in got] == [(True, "a", None), (True, "@s/a", None), (True, "@s/a", "1"), (True, "a", "1@2"), (False, None, None), (False, None, None)]


@pytest.mark.parametrize(
    "spec, want",
    [
        ("npx -y left-pad@1", ("npm", "left-pad@1", None)), ("python -m mod", ("pypi", "mod", None)), ("python x.py", (None, None, "unverifiable")), ("node x", (None, None, "unverifiable")),
        ("uvx --from pkg cmd", ("pypi", "pkg", None)), ("uvx --from git+https://x y", (None, None, "unverifiable")), ("npx", (None, None, "error")), ("npx -y", (None, None, "error")), ("", (None, None, "error")),
        ("pipx run tool", (None, None, "error")), ("pipx run thing", ("pypi", "thing", None)), ("cargo install rg", ("crates", "rg", None)), ("@s/p", ("npm", "@s/p", None)), ("a/b", (None, None, "unverifiable")), ("discordi.js", ("npm", "discordi.js", None)), ("npm --package", (None, None, "error")),
    ],
)
def test_commands(spark, spec, want):
    r = packages.resolve_commands(spark.createDataFrame([(spec,)], "spec string")).first()
    assert (r.ecosystem, r.package, r.note) == want


def test_verify_end_to_end(spark):
    asked = spark.createDataFrame([("npm", "good", None), ("npm", "good", "9"), ("npm", "gone", None), ("npm", "bad", "1"), ("npm", "weak", "1"), ("crates", "c", None)], "ecosystem string, name string, version string")
    meta = spark.createDataFrame([("npm", n, "2", "2020-01-01T00:00:00Z", ["1", "2"]) for n in ("good", "bad", "weak")] + [("crates", "c", None, None, ["1"])], "ecosystem string, name string, latest_version string, created string, versions array<string>")
    adv = spark.createDataFrame(
        [("npm", "bad", "MAL-1", "evil", None, None, None), ("npm", "weak", "A-1", None, "high", None, ["1"]), ("npm", "good", "A-2", None, "low", None, ["1"]), ("npm", "good", "A-3", None, None, "2020", None), ("crates", "c", "A-4", None, None, None, ["0"])],
        "ecosystem string, name string, id string, summary string, severity string, withdrawn string, affected array<string>",
    )
    rep = spark.createDataFrame([("npm", n, None, None, 5000, "weekly") for n in ("good", "weak")], "ecosystem string, name string, created string, latest_version string, downloads long, downloads_window string")
    out = packages.verify(asked, meta, adv, rep, now())
    got = {(r.name, r.version): (r.verdict, r.downloads) for r in out.collect()}
    assert got == {("good", None): ("OK", 5000), ("good", "9"): ("MISSING", None), ("gone", None): ("MISSING", None), ("bad", "1"): ("MALICIOUS", None), ("weak", "1"): ("VULNERABLE", None), ("c", None): ("VULNERABLE", None)}
    allowed = spark.createDataFrame([("npm", "weak", "1")], "ecosystem string, name string, version string")
    after = {r.name: (r.verdict, r.reason) for r in packages.apply_allowlist(out, allowed).where("name = 'weak'").collect()}
    assert after == {"weak": ("OK", "allowed, was VULNERABLE")}


def test_predicted_names(spark):
    own = spark.createDataFrame([("crates", "mine", 0), ("crates", "serde-utils", 1)], "ecosystem string, name string, ord int")
    got = [r.predicted for r in packages.predicted_names(own).orderBy("ord").collect()]
    assert got[:9] == [f"mine{s}" for s in "-utils -helper -client -sdk -core -async -tools -derive -macros".split()]
    assert "serde-utils" not in got and "serde-helper" in got and len(got) == len(set(got))
    assert packages.predicted_names(own, 3).count() == 3


def test_predicted_names_of_a_query_know_every_part(spark, tmp_path):
    spark.range(1, 201).selectExpr("id AS p_partkey", "concat('p ', id) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    existing = package_queries._existing(spark, str(tmp_path))
    assert existing.count() == 200
    got = package_queries.foresee_candidates(spark, str(tmp_path))
    assert {r["count"] for r in got.groupBy("ecosystem").count().collect()} == {80}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_fresh_squats_are_guarded(spark):
    new, old = "2024-05-01T00:00:00Z", "2020-01-01T00:00:00Z"
    rows = [("m", "MISSING", None, None), ("x", "MALICIOUS", old, 9), ("l", "LOOKALIKE", old, 9), ("s", "SUSPICIOUS", new, 5), ("v", "VULNERABLE", new, None), ("o", "OK", new, None), ("u", "OK", new, 50), ("a", "SUSPICIOUS", old, 5)]
    df = spark.createDataFrame(rows, "name string, verdict string, created string, downloads long")
    got = {r.name: (r.guard, r.trap) for r in packages.classify_predicted(df, now()).collect()}
    assert got == {"m": (True, False), **dict.fromkeys("xlsvo", (True, True)), "u": (False, False), "a": (False, False)}


def small_feeds(spark, meta):
    return {
        "metadata": spark.createDataFrame([("crates", n, v, c, ["1"]) for n, v, c in meta], "ecosystem string, name string, latest_version string, created string, versions array<string>"),
        "advisories": spark.createDataFrame([("crates", "mine-helper", "MAL-1", None, None, None, None)], "ecosystem string, name string, id string, summary string, severity string, withdrawn string, affected array<string>"),
        "reputation": spark.createDataFrame([], "ecosystem string, name string, created string, latest_version string, downloads long, downloads_window string"),
    }


def test_foresee_verifies_predicted_names(spark):
    new, old = "2024-05-01T00:00:00Z", "2020-01-01T00:00:00Z"
    f = small_feeds(spark, [("mine-utils", "1", new), ("mine-helper", "1", old), ("mine-client", "1", new), ("mine-sdk", "2", new), ("mine-core", "1", old)])
    own = spark.createDataFrame([("crates", "mine", 0)], "ecosystem string, name string, ord int")
    allowed = spark.createDataFrame([("crates", "mine-client", "1"), ("crates", "mine-sdk", "1")], "ecosystem string, name string, version string")
    got = {r.name: (r.guard, r.trap) for r in packages.foresee(own, f, allowed, now(), 6).collect()}
    assert got == {"mine-utils": (True, True), "mine-helper": (True, True), "mine-sdk": (True, True), "mine-core": (False, False), "mine-async": (True, False)}


def test_inspect_with_an_allowlist(spark):
    f = small_feeds(spark, [("mine-helper", "1", None), ("fine", "1", None)])
    commands = spark.createDataFrame([("cargo install mine-helper",), ("cargo install fine",), ("cargo install gone",)], "spec string")
    findings = spark.createDataFrame([("cargo install fine", 0, "ff"), ("cargo install gone", 0, None)], "spec string, severity_rank int, fingerprint string")
    allowed = spark.createDataFrame([("crates", "mine-helper", "1")], "ecosystem string, name string, version string")
    cleared = spark.createDataFrame([("manifest", "ff")], "kind string, fingerprint string")
    trust = lambda *a: [r.trust for r in packages.inspect(commands, f, now(), findings, *a).orderBy(F.desc("spec")).collect()]
    assert trust() == ["AVOID", "AVOID", "AVOID"]
    assert trust(allowed, cleared) == ["GREEN", "AVOID", "GREEN"]


def test_fnv(spark):
    assert hashing.fnv1a(b"") == "cbf29ce484222325" and hashing.fnv1a(b"a") == "af63dc4c8601ec8c"
    texts = ["", "a", "foobar", "é" * 40, "x" * 1000]
    assert hashing.fnv1a_many([t.encode() for t in texts]) == [hashing.fnv1a(t.encode()) for t in texts]
    assert column(spark, hashing.fnv1a_hex, "a", None, "foobar") == ["af63dc4c8601ec8c", None, hashing.fnv1a(b"foobar")]


def test_manifest_fingerprint_ignores_order(spark):
    a = '[{"name":"b","x":1},{"name":"a","y":{"p":1,"q":2}}]'
    b = '[{"y":{"q":2,"p":1},"name":"a"}, {"x":1,"name":"b"}]'
    got = column(spark, hashing.manifest_fingerprint, a, b, a.replace("1", "3"), "{")
    assert got[0] == got[1] != got[2] and got[3] is None


def test_json_walks(spark):
    text = '{"b":{"k":"2"},"a":["1",{"k":3}],"c":"4"}'
    assert column(spark, jsontree.string_values, text, "x", '"s"') == [["1", "2", "4"], None, ["s"]]
    deep = '{"a":' * 50 + "1" + "}" * 50
    nodes = column(spark, jsontree.nodes, deep)[0]
    assert [(n.ord, n.parent, n.depth) for n in nodes] == [(i, i - 1, i) for i in range(50)]
    hooks = column(spark, jsontree.nodes, '{"hooks":[{"a":{"hooks":{"b":[1,{"c":2}]}}}],"d":"x"}')[0]
    assert [(n.key, n.parent, n.value, list(n.under)) for n in hooks] == [("d", -1, "x", []), ("hooks", -1, "[]", []), ("a", 1, "{}", ["hooks"]), ("hooks", 2, "{}", ["hooks"]), ("b", 3, "[1]", ["hooks"]), ("c", 4, "2", ["hooks"])]
    assert column(spark, lambda x: jsontree.strict_bool(x, "h"), '{"h":true}', '{"h":"true"}', '{"h":1}', "{}", "no") == [True, None, None, None, None]


VALUES = [1, -0.5, 1e300, "", "a\u2028\"\\é\n", True, None, [], {}, {"b": [{}, [[]], {"a": 1}], "a": {"c": None}}, [[[1], 2], "x"], {"é": {"": [0]}}]


@pytest.mark.parametrize("depth", [0, 300, 1500, 100_000])
def test_json_of_any_depth_is_read_and_written(depth):
    for v in VALUES:
        text = '{"k":[' * depth + json.dumps(v) + "]}" * depth
        found = jsontree.built(f" {text} ")
        assert jsontree.canonical(found) == '{"k":[' * depth + json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "]}" * depth
        for _ in range(depth):
            found = found["k"][0]
        assert found == v


def test_broken_json_is_refused():
    for text in ["", " ", "[", "{", "[1,]", "[,1]", '{"a":}', '{"a" 1}', '{"a":1,}', "{1:2}", "1 2", "nul", "01", '"a', "[1}", '{"a":1]', "]", "tru", "+1", '["a\n"]', "'a'"]:
        with pytest.raises(ValueError):
            jsontree.built(text)
        with pytest.raises(ValueError):
            json.loads(text)


def test_deep_manifests_give_findings(spark):
    """Linear in the depth, and never a lost row."""
    deep = lambda n: json.dumps([{"name": "t", "inputSchema": 0}])[:-3] + '{"a":' * n + '"ignore previous"' + "}" * n + "}]"
    rows = spark.createDataFrame([(n, deep(n)) for n in (300, 999, 1500, 100_000)] + [(1, deep(1500)[:-1]), (2, "[" * 200_000)], "m int, text string")
    got = sorted((r.m, r.category) for r in manifest.scan_manifests(rows, "m").collect())
    assert got == [(1, "unreadable-manifest"), (2, "unreadable-manifest")] + [(n, "prompt-injection") for n in (300, 999, 1500, 100_000)]
    sizes = [sum(len(n.value) + len(n.key) + 8 * len(n.under) for n in column(spark, jsontree.nodes, '{"hooks":' * d + "1" + "}" * d)[0]) for d in (400, 4000, 40_000)]
    assert sizes[1] < 11 * sizes[0] and sizes[2] < 11 * sizes[1] and sizes[2] < 40_000 * 20
    locked = "{" + '"dependencies":{"a":{"version":"1",' * 2000 + '"x":0' + "}}" * 2000 + "}"
    assert [p.version for p in column(spark, jsontree.locked_packages, locked)[0]] == ["1"] * 2000


def test_flags_of_a_batch_hold_one_value_at_a_time():
    """Parsed, a deep text takes many times its size."""
    deep = '{"h":true,"x":' + '{"a":[' * 2000 + "]}" * 2000 + "}"

    def peak(n):
        tracemalloc.start()
        try:
            assert jsontree.top_booleans.func(pa.array([deep] * n + [None, "no", "[true]"])).to_pylist() == [[("h", True)]] * n + [[]] * 3
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(40) < 2 * peak(1)


def test_scans_of_deep_manifests_take_only_flags_of_annotations(spark):
    """Also where annotations are a text, a list or a number."""
    deep = '{"a":[' * 1500 + "]}" * 1500
    notes = ['{"x":%s,"openWorldHint":true,"destructiveHint":"true","b":false}' % deep, json.dumps('{"destructiveHint":true}'), '[true,"destructiveHint"]', "1", "null"]
    rows = spark.createDataFrame([(i, '[{"name":"t","inputSchema":%s,"annotations":%s},0]' % (deep, n)) for i, n in enumerate(notes)], "m int, text string")
    kept = {r.m: r.annotations for r in manifest.parse_tools(rows, ["m"], deep=jsontree.deep_flagged_tools).where("name is not null").collect()}
    assert kept == {0: '{"b":false,"openWorldHint":true}', 1: '{"destructiveHint":true}', 2: '[true,"destructiveHint"]', 3: "1", 4: None}
    whole = {r.m: r.annotations for r in manifest.parse_tools(rows, ["m"]).where("name is not null").collect()}
    assert len(whole[0]) > len(deep) and [whole[i] for i in range(1, 5)] == [kept[i] for i in range(1, 5)]
    flags = [(0, "INFO"), (1, "MEDIUM")]
    scanned = manifest.scan_manifests(rows, "m")
    assert sorted((r.m, r.severity) for r in scanned.where("category = 'annotation'").collect()) == flags
    staged = spark.read.parquet(*{f.rpartition("/")[0] for f in scanned.inputFiles()})
    assert staged.agg(F.max(F.length("annotations"))).first()[0] < 100


def test_cross_tool_triggers_of_a_large_manifest(spark):
    """100,000 tools that all steer: one pass over names and texts, dealt over several tasks."""
    n = 100_000
    rows = spark.range(n).select(F.lit("m").alias("manifest"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("Tool_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"),
        F.concat(F.lit("first call TOOL_"), F.lpad(((F.col("id") + 7) % n).cast("string"), 6, "0"), F.lit(" then tool_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("desc"))
    began = time.time()
    got = manifest.cross_tool(rows, "manifest").select("ord", "message").collect()
    assert len(got) == n and time.time() - began < 90
    assert all(r.message == f"steers to the tool tool_{(r.ord + 7) % n:06d}" for r in got)


def test_fnv_by_vector_steps():
    def plain(data, h=hashing.BASIS):
        for b in data:
            h = (h ^ b) * hashing.PRIME % 2**64
        return h

    rng = np.random.default_rng(3)
    for n in (0, 1, hashing.SHORT - 1, hashing.SHORT, 5000, hashing.CHUNK + 1):
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        assert hashing.folded(hashing.BASIS, data) == plain(data) == hashing.folded(hashing.folded(hashing.BASIS, data[: n // 3]), data[n // 3 :])
    items = [rng.integers(0, 256, int(n), np.uint8).tobytes() for n in rng.integers(0, 300, 200)] + [b"", b"x" * 400_000, b"y" * 2000]
    began = time.time()
    assert hashing.fnv1a_many(items) == [f"{plain(x):016x}" for x in items]
    long = bytes(15 << 20)
    began = time.time()
    hashing.fnv1a_many([long])
    assert time.time() - began < 5


def test_fingerprints_of_large_trees(spark):
    """Files of trees in one partition, across batches: the same as one hash over the whole tree."""
    files = [(s, f"{s}/{i:03d}", None if i == 5 else "é" * (i * 40)) for s in ("a", "b", "c") for i in range(60)] + [("d", None, "x")]
    df = spark.createDataFrame(files, "skill string, path string, text string").repartition(7)
    want = {}
    for s, path, text in sorted(files, key=lambda f: (f[0], f[1] or "")):
        data = (text or "").encode()
        want[s] = hashing.folded(want.get(s, hashing.BASIS), (path or "").encode() + b"\0" + len(data).to_bytes(8, "little") + data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.skill: r.fingerprint for r in surface.skill_fingerprints(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {s: f"{h:016x}" for s, h in want.items()}


def test_allowlist_store(spark):
    text = '[packages."npm:a"]\necosystem = "npm"\nname = "a"\nversions = ["2", "1", "1"]\n[fingerprints."skill:ff"]\nkind = "skill"\nid = "s"\nfingerprint = "ff"\n'
    p, f = allowlist.parse(spark, text)
    assert [tuple(r)[:2] for r in allowlist.rows_by_key(p, f).collect()] == [("npm:a", "1, 2"), ("skill:ff", "s")]
    again = allowlist.parse(spark, allowlist.render(p, f))
    assert allowlist.rows_by_key(*again).collect() == allowlist.rows_by_key(p, f).collect()
    gone = allowlist.remove(p, spark.createDataFrame([("npm", "a", "1")], "ecosystem string, name string, version string"))
    assert {r.version for r in gone.collect()} == {"2"} and allowlist.clear(p).count() == 0
    assert allowlist.parse(spark, None)[0].count() == 0
    with pytest.raises(ValueError):
        allowlist.parse(spark, "not = = toml")


def test_cache(spark):
    t = datetime.datetime(2024, 6, 1)
    h = datetime.timedelta(hours=1)
    rows = [("GET", "a", "", 200, "old", t - 2 * h), ("GET", "a", "", 404, "new", t - h), ("GET", "b", "", 500, "x", t), ("GET", "c", "", 200, "x", t - 7 * h), ("GET", "d", "", 200, "x", t + h)]
    df = spark.createDataFrame(rows, feeds.RESPONSE)
    cached = feeds.fresh(df, now())
    assert [(r.url, r.body) for r in cached.collect()] == [("a", "new")]
    asked = spark.createDataFrame([("GET", "a"), ("GET", "c")], "method string, url string")
    assert [r.url for r in feeds.misses(asked, cached).collect()] == ["c"]
    posts = spark.createDataFrame([("POST", "p", "one", 200, "x", t)], feeds.RESPONSE)
    asked = spark.createDataFrame([("POST", "p", "one"), ("POST", "p", "two"), ("POST", "p", None)], "method string, url string, body_match string")
    assert sorted((r.body_match for r in feeds.misses(asked, posts).collect()), key=str) == [None, "two"]


def test_advisories_with_affected_versions(spark):
    body = '{"vulns": [{"id": "A-1", "affected": [{"versions": ["1.0", "1.1"]}, {"versions": ["2.0"]}]}, {"id": "A-2", "affected": [{}]}, {"id": "A-3", "withdrawn": "2024-01-01", "affected": [{"versions": ["3.0"]}]}]}'
    a = feeds.advisories(spark.createDataFrame([("npm", "x", 200, body)], "ecosystem string, name string, status int, body string"))
    assert {r.id: r.affected for r in a.collect()} == {"A-1": ["1.0", "1.1", "2.0"], "A-2": None, "A-3": ["3.0"]}
    asked = spark.createDataFrame([("npm", "x", v, v) for v in ("1.1", "3.0", "9.9")], "ecosystem string, name string, version string, effective string")
    got = {r.version: [v["id"] for v in r.vulnerabilities] for r in packages.with_advisories(asked, a).collect()}
    assert got == {"1.1": ["A-1", "A-2"], "3.0": ["A-2"], "9.9": ["A-2"]}


def test_http_feed_reports_transport_errors(spark):
    feeds.register(spark)
    rows = spark.read.format("http_feed").option("urls", "http://127.0.0.1:9/x\nnonsense").option("timeout", "2").load().collect()
    assert len(rows) == 2 and all(r.error and r.status is None for r in rows)


def test_locks_cut_in_their_rows_equal_locks_scanned_by_line(spark, monkeypatch):
    """Random lines, among them heads without a name, repeated sections and values, and files of no block."""
    rng = random.Random(3)
    yarn = ["a@^1:", '"@s/b@^1", "@s/b@^2":', ":", "x:", '  version "1"', "  version 2  ", '  resolved "https://r/x"', "  integrity sha512-x", "# note", "", "\t", "    deep:", "__metadata:", "  version:"]
    pnpm = ["packages:", "other:", "  /a@1(p@2):", "  '@s/b@2':", "  c@3:", "    resolution: {integrity: x, tarball: https://t/x}", "    resolution: {integrity: }", "    tarball: https://u", "      integrity: y", "  z:", "", "# n", "lockfileVersion: 6", "  bad"]
    for reader, kinds in ((dependencies.yarn_lock, yarn), (dependencies.pnpm_lock, pnpm)):
        files = [(i, rng.choice(["\n", "\r\n"]).join(rng.choice(kinds) for _ in range(rng.randint(0, 25)))) for i in range(150)] + [(900, None), (901, "")]
        df = spark.createDataFrame(files, "f int, text string")
        rows = lambda: sorted(map(tuple, reader(df, "f").select("f", "ord", "name", "version", "resolved", "has_integrity").collect()), key=repr)
        monkeypatch.setattr(dependencies, "SHORT", 1 << 20)
        short = rows()
        monkeypatch.setattr(dependencies, "SHORT", -1)
        assert short == rows() and len(short) > 50


def test_plans_of_readers_broadcast_nothing_that_grows(spark, tmp_path):
    """Sizes that are guessed from a small Parquet file don't make a broadcast of what is read from its texts."""
    spark.range(50).write.parquet(f"{tmp_path}/k")
    keys = spark.read.parquet(f"{tmp_path}/k").select(F.col("id").cast("string").alias("f"))
    files = keys.withColumn("text", F.lit("a@1:\n  version 1"))
    bodies = keys.select(F.lit("npm").alias("ecosystem"), F.col("f").alias("name"), F.lit(200).alias("status"), F.lit('{"vulns":[{"id":"A"}]}').alias("body"))
    asked = keys.select(F.lit("npm").alias("ecosystem"), F.col("f").alias("name"), F.lit("1").alias("version"), F.lit("1").alias("effective"))
    for df in (dependencies.yarn_lock(files, "f"), dependencies.pnpm_lock(files, "f"), packages.with_advisories(asked, feeds.advisories(bodies))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_made_of_a_small_table_are_dealt_over_cores(spark, tmp_path):
    spark.range(64).selectExpr("id p_partkey", "'x y' p_name", "1 p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = dependency_queries.QUERIES["poetry_lock"](spark, str(tmp_path))
    tasks = found.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 2 and found.count() == 128


def test_names_predicted_in_rows_equal_names_predicted_by_joins(spark, monkeypatch):
    """Projects with few, many, scoped, empty and repeated names, and one without any; variants aren't shuffled for the first kind."""
    rng = random.Random(4)
    pool = ["react", "widget", "@acme/Widget", "react-cli", "@x/", "", "Flask", "lib", "py-lib", "lib-utils", None]
    rows = [(f"d{d}", ("npm", "pypi", "crates")[d % 3], rng.choice(pool) if d % 4 else f"n{i}", i) for d in range(20) for i in range(rng.choice([1, 3, 8]))]
    df = spark.createDataFrame(rows, "directory string, ecosystem string, name string, ord long")
    got = lambda: sorted(map(tuple, packages.predicted_names(df, 30, "directory").collect()))
    monkeypatch.setattr(packages, "FEW_NAMES", 64)
    few, plan = got(), packages.predicted_names(df, 30, "directory")._jdf.queryExecution().optimizedPlan().toString()
    assert len(few) > 400 and "affix_ord" in plan and "min(struct" not in plan
    for n in (0, 3):
        monkeypatch.setattr(packages, "FEW_NAMES", n)
        assert got() == few
