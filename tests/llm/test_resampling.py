import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cinderlake.llm import resampling as module
from cinderlake.llm.resampling import bucketed, op12_resampling, ranked, resample, suffix_order


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def grams(text, max_n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=10, max_n=1, buckets=10_000, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    found = [(i, *grams(t, max_n)) for i, t in rows]
    s, t = Counter(bucket(g) for _, _, f in found for g in f), Counter(bucket(g) for x in target for g in grams(x, max_n)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain(bucket(g)) for g in f) / len(f)) if f else 0
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    ranks = {id(x): r for r, x in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*x[:4], ranks.get(id(x))) for x in out), key=repr)


def test_suffix_order_and_shared_prefixes():
    rng = random.Random(3)
    for depth in (1, 2, 3, 4, 5, 8):
        for _ in range(60):
            ids = [rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randint(0, 40))] + [0]
            order, shared = suffix_order(np.asarray(ids, np.int64), depth)
            cut = lambda p: (ids[p : p + depth] + [0])[: (ids[p : p + depth] + [0]).index(0)]
            assert sorted(order.tolist()) == list(range(len(ids)))
            for k, (p, q) in enumerate(zip(order[:-1].tolist(), order[1:].tolist()), 1):
                both = 0
                for x, y in zip(cut(p), cut(q)):
                    if x != y:
                        break
                    both += 1
                assert shared[k] == both
            for n in range(1, depth + 1):  # places that share n words stand together
                heads = [tuple(cut(p)[:n]) for p in order.tolist() if len(cut(p)) >= n]
                assert sum(a != b for a, b in zip(heads, heads[1:])) + 1 == len(set(heads)) or not heads


@pytest.mark.parametrize("max_n,buckets", [(1, 10_000), (2, 50), (3, 100_000), (5, 7)])
def test_buckets_equal_hashing_each_ngram(max_n, buckets):
    rng = random.Random(max_n)
    texts = [" ".join(rng.choice(["a", "B", "b", "é", "x1", "_", "a-b"]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", "only"]
    sizes, found = bucketed([t.encode() for t in texts], max_n, buckets)
    for t, size, f in zip(texts, sizes, found):
        n, want = grams(t, max_n)
        assert size == n and f.tolist() == [zlib.crc32(g.encode()) % buckets for g in want]


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(f"{rng.choice('vw')}{rng.randrange(60)}" for _ in range(rng.randint(0, 60)))) for i in range(n)]


ODD = [(1000, None), (1001, ""), (1002, "-- __ !!"), (1003, "word " * 30_000), (None, "a b c " * 10), (5, "w1 " * 25), (5, "w1 " * 25), (1004, "É é Ä_b-C " * 9)]


@pytest.mark.parametrize("max_n,percent,least", [(1, 10, 20), (2, 35, 0), (3, 100, 5)])
def test_operator_against_plain_version(spark, monkeypatch, max_n, percent, least):
    monkeypatch.setattr(module, "BLOCK", 3000)
    rows, target = corpus(max_n, 150) + ODD, ["w1 w2 w3 w4", None, "", "w5 é " * 20]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, rank int, weight string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(df, wanted, percent=percent, max_n=max_n, buckets=500, least_words=least)
    got = sorted(map(tuple, got.collect()), key=repr)
    want = plain(rows, target, percent, max_n, 500, least)
    free = lambda found: [x if x[0] != 5 else (*x[:4], None) for x in found]  # noqa: E731  the rows of id 5 that tie are drawn in any order
    assert free(got) == free(want)
    assert sorted(x[4] for x in got if x[4]) == list(range(1, sum(1 for x in want if x[4]) + 1))


def test_query_and_empty_tables(spark, tmp_path):
    rows, target = corpus(9, 200), [(1, "w1 w2 w3 " * 5), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(target, "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    got = op12_resampling(spark, f"{tmp_path}/a")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, [t for _, t in target])
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, docs).collect() == []
    assert sorted(map(tuple, resample(docs, none).collect()), key=repr) == plain(rows, [])


def test_ranks_run_through_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "score long, id long")
    got = {(r.score, r.id): r["rank"] for r in ranked(df, df.score.desc(), df.id).collect()}
    assert got == {x: n for n, x in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)}
