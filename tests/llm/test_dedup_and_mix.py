import hashlib
import random
import re

from pyspark.sql import functions as F

from cinderlake.llm.exact_dedup import exact_dedup, op10_exact_dedup
from cinderlake.llm.mixing import mix, mixed_rows, water_fill, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup_against_plain_grouping(spark):
    long_text = "word " * 40_000
    texts = [None, "", " ", "Äpfel", "äpfel", "ÄPFEL", "abc", "ABC", "abd", long_text, long_text.upper(), "x" * 64 + "a", "x" * 64 + "b", "x" * 64 + "A"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, keep_id int, len string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_dedup_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(empty).collect() == []
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup(twice).collect())) == [(1, 1, 2, True), (1, 1, 2, True), (2, 2, 1, True)]
    null_id = spark.createDataFrame([(None, "a"), (3, "A"), (None, "q")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup(null_id).collect()), key=repr)
    assert got == [(3, 3, 2, True), (None, 3, 2, False), (None, None, 1, True)]


def test_op10_gives_a_verdict_for_each_row(spark, tmp_path):
    head = "x" * 64
    rows = [(5, head + "a"), (5, head + "b"), (9, head + "B"), (None, "q"), (None, "Q"), (None, "alone"), (5, "other"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(lower(t).encode()).hexdigest()
    want = [(5, 5, 1, True, sha(head + "a")), (5, 9, 2, False, sha(head + "b")), (9, 9, 2, True, sha(head + "b")), (None, None, 2, True, sha("q")), (None, None, 2, True, sha("q")), (None, None, 1, True, sha("alone")), (5, 5, 1, True, sha("other")), (7, 7, 1, True, sha(""))]
    assert sorted(map(tuple, op10_exact_dedup(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup(docs).collect()), key=repr) == sorted((w[:4] for w in want), key=repr)


def plain_targets(sizes, weights, cap):
    total, open_, out = sum(sizes.values()), dict(weights), {}
    while True:
        rest = total - sum(out.values())
        over = {s for s in open_ if rest * open_[s] / sum(open_.values()) > cap * sizes[s] + 1e-9}
        if not over:
            return out | {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        for s in over:
            out[s] = cap * sizes[s]
            del open_[s]


def test_water_filling_matches_rounds_of_clamping(spark):
    rng = random.Random(5)
    for _ in range(3):
        names = [f"s{i:02d}" for i in range(rng.randint(2, 9))]
        sizes = {s: rng.choice([1, 5, 50, 1000, 20_000]) for s in names}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(names))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in water_fill(df).collect()}
        want = plain_targets(sizes, weights, 3)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in names)


def test_mix_reaches_targets_with_whole_and_fractional_repetitions(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(300)]
    rows += [(300, None, None, "empty", None), (301, "one", "en", "a", 3), (301, "one", "en", "a", 3)]
    df = spark.createDataFrame(rows, DOCS)
    got = mix(df.select("doc_id", "source", words(F.col("text")).alias("size"))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[3] += r.size
        assert 0 <= r.taken <= 3 * r.size
    assert sum(s[1] for s in by.values()) - sum(s[2] for s in by.values()) < 1e-6
    for taken, target, size, own in by.values():
        assert size == own and taken == int(target)
    again = mix(df.repartition(7).select("doc_id", "source", words(F.col("text")).alias("size"))).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    out = mixed_rows(df)
    assert out.columns == df.columns
    total = out.select(F.sum(words(F.col("text")))).first()[0]
    assert total == sum(s[0] for s in by.values())
    assert out.where("n_chars <> length(text)").isEmpty()


def test_mix_keeps_columns_of_clashing_names(spark):
    rows = [(i, "a b c", "s", 7, 8, 9, 10) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int, taken int, slot_size int")
    out = mixed_rows(df)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {(7, 8, 9, 10)}
    odd = ["_key", "_slot", "_none", "_src", "slot_size", "n"]
    df = spark.createDataFrame([(i, "s", 3, *range(6)) for i in range(5)], f"doc_id long, source string, size long, {', '.join(f'{c} int' for c in odd)}")
    assert {tuple(r) for r in mix(df).select(*odd).collect()} == {tuple(range(6))}


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixed_rows(empty).collect() == []


def test_dedup_digest_uses_normalised_text(spark):
    from cinderlake.llm.common import ascii_lower

    df = spark.createDataFrame([("AbÉ",), ("ABC",)], "t string")
    got = [r[0] for r in df.select(F.sha2(ascii_lower(F.col("t")), 256)).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ("abÉ", "abc")]
