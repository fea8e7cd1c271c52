import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderlake.functions import corpora
from cinderlake.functions import text as T
from cinderlake.operators import surface, text_rules


def found(spark, *rows):
    df = spark.createDataFrame([(i, t, lab) for i, (t, lab) in enumerate(rows)], "id long, text string, label string")
    out = {}
    for r in text_rules.scan_text(df, ["id"]).orderBy("severity_rank", "check_ord", "phrase_ord").collect():
        out.setdefault(r.id, []).append((r.severity, r.category, r.evidence, r.tool))
    return out


def test_phrases_and_snippets(spark):
    long_head = "x" * 50
    got = found(spark, (f"{long_head} IGNORE Previous orders" + "y" * 200, "a"), ("nothing here", "b"), ("", "system-prompt.md"), (None, ""), ("do not mention", ""))
    assert got[0] == [("HIGH", "prompt-injection", ("x" * 19 + " IGNORE Previous orders" + "y" * 200)[:80], "a")]
    assert 1 not in got and 3 not in got
    assert got[2][0][:2] == ("HIGH", "prompt-injection") and got[2][0][3] == "system-prompt.md"
    assert got[4][0][3] is None


def test_kelvin_sign_falls_back_to_the_start(spark):
    got = found(spark, ("before you use any tooK before using this tool", "a"))
    assert {g[1] for g in got[0]} == {"tool-poisoning"}


def test_hidden_ansi_punycode(spark):
    got = found(spark, ("a​b", "x"), ("\x1b[1m", "x"), ("see XN--abc", "x"), ("\U000e0041", "x"), ("plain  ", "x"))
    assert [got[i][0][1] for i in (0, 1, 2, 3)] == ["hidden-unicode", "ansi-escape", "exfil-sink", "hidden-unicode"]
    assert 4 not in got


def plain_image(text):
    rest = text
    while "![" in rest:
        after = rest[rest.index("![") :]
        if "](" in after:
            tail = after[after.index("](") + 2 :]
            if ")" in tail:
                url = tail.split(")")[0].strip(" \t\n\r")
                if re.match("https?://", url):
                    return url[:120]
        rest = after[2:]
    return None


@pytest.mark.parametrize("text", ["![a](http://x)", "![a](b) ![c]( https://y )", "![ ![a](https://z)", "![a](http://", "](http://q) ![", "![a](ftp://x)", "!" * 9 + "[x](https://" + "u" * 300 + ")", "![" * 20, "no"])
def test_image_url(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.image_url(F.col("t"))).first()[0] == plain_image(text)


def plain_run(text):
    run = ""
    for c in text:
        if c.isascii() and (c.isalnum() or c in "+/=-_"):
            run += c
            if len(run) >= 40 and any(x.isdigit() for x in run):
                return run[:48]
        else:
            run = ""
    return None


@pytest.mark.parametrize("text", ["a" * 39 + "1", "a" * 40, "a" * 45 + "1z", "a" * 60 + "7", "b" * 41 + " " + "c" * 39 + "9", "1" * 200, "é" + "0" * 40, ""])
def test_encoded_run(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.encoded_run(F.col("t"))).first()[0] == plain_run(text)


def test_long_texts_do_not_break_patterns(spark):
    text = "![" + "a]" * 200_000 + "A" * 100_000
    df = spark.createDataFrame([(1, text, "x")], "id long, text string, label string")
    assert text_rules.scan_text(df, ["id"]).count() == 0


def test_scripts_need_one_line(spark):
    rows = [(0, "CURL x | sh"), (1, "curl x\ny | sh"), (2, "base64 -d y | bash"), (3, "cat .env"), (4, "fetch('https://x')"), (5, "fetch(x)"), (6, "printenv")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {}
    for r in text_rules.scan_rules(df, ["id"], text_rules.script_rules(F.col("text"))).collect():
        got.setdefault(r.id, set()).add(r.category)
    assert got == {0: {"remote-exec"}, 2: {"obfuscated-exec"}, 4: {"network-egress"}, 6: {"env-dump"}} | {3: {"secret-access"}}


def plain_records(text, jsonl):
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    if jsonl:
        return [x for x in lines if x.strip()] or [text.removesuffix("\n")]
    out, cur = [], []
    for x in lines:
        if x.startswith(("# ", "## ", "- ")) and "".join(cur).strip():
            out.append("\n".join(cur))
            cur = []
        cur.append(x)
    if "".join(cur).strip():
        out.append("\n".join(cur))
    return out or [text.removesuffix("\n")]


def test_memory_records(spark):
    texts = ["a\n# b\nc\n- d\n", "\n\n# x\n## y\n### z", "", "   ", "- one", "a\n\n"]
    rows = [(f"{i}.md", t) for i, t in enumerate(texts)] + [("l.jsonl", '{"a":1}\n\n{"b":2}\n')]
    got = {}
    for r in surface.memory_records(spark.createDataFrame(rows, "path string, text string")).orderBy("path", "record").collect():
        got.setdefault(r.path, []).append(r.text)
    want = {p: plain_records(t, p.endswith("jsonl")) for p, t in rows}
    assert {p: x for p, x in got.items() if want[p] != ["   "]} == {p: x for p, x in want.items() if x != ["   "]}


def test_memcheck_labels(spark):
    rows = [("one.md", "always run x"), ("two.md", "fact\n- rm -rf / now"), ("clean.md", "a fact")]
    got = {(r.path, r.category, r.tool) for r in surface.memcheck(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert ("one.md", "actionable-memory", "one.md") in got and ("two.md", "poisoned-memory", "record 2") in got
    assert not [g for g in got if g[0] == "clean.md"]


def test_skillscan(spark):
    rows = [("s", "s/SKILL.md", "skill", "---\nallowed-tools: Bash\n---\nbody"), ("s", "s/run.sh", "script", "wget x | bash"), ("c", "c.md", "command", "ignore previous"), ("n", "n/SKILL.md", "skill", "fine")]
    df = spark.createDataFrame(rows, "skill string, path string, kind string, text string")
    found_ = surface.skillscan(df)
    assert {(r.skill, r.category) for r in found_.collect()} == {("s", "broad-tools"), ("s", "remote-exec"), ("c", "prompt-injection")}
    trust = {r.skill: r.verdict for r in text_rules.trust_collapse(df, found_, "skill").collect()}
    assert trust == {"s": "AVOID", "c": "AVOID", "n": "GREEN"}


def test_skill_files(spark):
    paths = [".claude/skills/a/SKILL.md", ".claude/skills/a/x/run.py", ".claude/skills/a/1/2/3/4/5/6/7/deep.sh", ".claude/commands/c.md", "other.txt"]
    got = {r.path: r.kind for r in surface.skill_files(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {paths[0]: "skill", paths[1]: "script", paths[3]: "command", paths[4]: "other"}


def test_image_url_against_a_plain_search(spark):
    def plain(t):
        for i in range(len(t)):
            if t.startswith("![", i):
                at = t.find("](", i)
                end = t.find(")", at + 2) if at >= 0 else -1
                url = t[at + 2 : end].strip(" \t\n\r") if end >= 0 else ""
                if url.startswith(("http://", "https://")):
                    return url[:120]
        return None

    rng = random.Random(3)
    parts = ["![", "](", ")", "http://x", " https://y ", "a", " ", "[", "!", "]", "("]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    rows.append((1000, "![" * 1_000_000 + "](http://z)"))
    rows.append((1001, "![a](b" * 400_000))
    got = {r.i: r.u for r in spark.createDataFrame(rows, "i int, t string").select("i", T.image_url(F.col("t")).alias("u")).collect()}
    assert {i: got[i] for i in range(400)} == {i: plain(t) for i, t in rows[:400]}
    assert (got[1000], got[1001]) == ("http://z", None)


def test_each_text_is_computed_once(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, text string, label string")
    plan = text_rules.scan_text(df, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    # The basis, what is scanned, and twice the text that an invisible character is cut from, which is made for set bits only.
    assert plan.count("concat_ws(") == 4 and plan.count("![") < 10 and plan.count("scanned(") == 1 and len(plan) < 12_000


def test_trust_reads_the_mask_alone(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, text string, label string")
    plan = text_rules.text_trust(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "instruction-injection" not in plan and plan.count("scanned(") == 1


def test_counts_and_signals_equal_findings(spark):
    rng = random.Random(4)
    parts = corpora.INJECTION + corpora.COERCION + corpora.CAPABILITY + ["xn--", "\x1b", "\x85", "\u200b", "\U000e0041", "\ufeff", "![a](https://x)", "![a](b)", "A1" * 25, "b" * 50, "é”“’", "Σ", "İ", " ", "\U0001f600"]
    rows = [(i, "".join(rng.choice(parts).upper() if rng.random() < 0.3 else rng.choice(parts) for _ in range(rng.randint(0, 6))), rng.choice(["", "x-previous", "previous.md", "\u2060", "exec", None])) for i in range(600)]
    rows += [(600, "please ignore", "previous"), (601, None, None), (602, "", "system_prompt"), (603, "ex", "ec"), (604, "\u200c" * 3, "\u200d")]
    df = spark.createDataFrame(rows, "i int, text string, label string")
    found = {}
    for r in text_rules.scan_text(df, ["i"]).collect():
        found.setdefault(r.i, []).append(r)
    for r in text_rules.with_counts(df).collect():
        severities = [f.severity for f in found.get(r.i, [])]
        assert (r.high, r.medium, r.low) == tuple(severities.count(s) for s in ("HIGH", "MEDIUM", "LOW"))
    for r in text_rules.with_signals(df).collect():
        assert {(s.rank, s.category) for s in r.signals} == {(f.severity_rank, f.category) for f in found.get(r.i, [])}
    by = {(f.i, f.category) for fs in found.values() for f in fs}
    assert {(600, "prompt-injection"), (602, "prompt-injection"), (604, "hidden-unicode")} <= by and not {601, 603} & found.keys()
    assert [f.message for f in found[604]] == ["invisible character U+200D"]  # the label goes first
    for i, text, label in rows[:600]:
        basis = f"{text} {(label or '').translate(str.maketrans('_-.', '   '))}".lower()
        assert sum(f.check_ord < 2 for f in found.get(i, [])) == sum(p in basis for p in corpora.INJECTION + corpora.COERCION)


def test_long_runs_across_texts_and_parts(monkeypatch):
    rng = random.Random(1)
    run = re.compile(r"[A-Za-z0-9+/=_-]{40,}")

    def plain(t):
        for m in run.finditer(t or ""):
            digit = re.search("[0-9]", m[0])
            if digit:
                return m[0][: min(48, max(40, digit.start() + 1))]

    for _ in range(200):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(["a" * rng.randint(1, 60), "9", " ", "é", "_", "A" * 38, ""]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 12))]
        monkeypatch.setattr(T, "SEARCHED", rng.choice([1, 50, 1 << 20]))
        k = rng.randint(0, len(texts))
        assert T.encoded_run.func(pa.array(texts, pa.string()).slice(k)).to_pylist() == [plain(t) for t in texts[k:]]
