import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cinderlake.llm import runs as module
from cinderlake.llm.runs import automaton, op11_periodic_runs, periodic_runs, runs_of, stretches, window_of


def plain(w, least=6, exponent=4):
    """All runs by comparing words q apart, for every q."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q):
                found[i, size] = min(q, found.get((i, size), q))
            i = j + 1
    return sorted((start, size, q) for (start, size), q in found.items())


def sequences(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        w = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            base = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
            w = w[:10] + base * rng.randint(2, 6) + base[: rng.randrange(9)] + w[10:]
        yield w


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3), (9, 2)])
def test_runs_equal_brute_force(least, exponent):
    g = window_of(least, exponent)
    for w in sequences(least * exponent, 700):
        want = plain(w, least, exponent)
        assert runs_of(w, least, exponent) == want
        assert sorted((lo + s, n, q) for lo, hi in stretches(np.asarray(w, np.int64), g, least) for s, n, q in runs_of(w[lo:hi], least, exponent)) == want


def test_blocks_of_ordered_sets(monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 4)
    for w in sequences(3, 300):
        assert runs_of(w, 2, 2) == plain(w, 2, 2)


def test_automaton_has_each_class_of_end_positions_once():
    for w in sequences(4, 60):
        length, link, end = automaton(w)
        sets = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                sets.setdefault(tuple(w[i:j]), set()).add(j)
        classes = {}
        for x, ends in sets.items():
            classes.setdefault(frozenset(ends), []).append(len(x))
        assert sorted(length[1:]) == sorted(max(x) for x in classes.values())
        assert all(length[p] < n for p, n in zip(link[1:], length[1:])) and sorted(e for e in end if e >= 0) == list(range(len(w)))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(w, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


TEXTS = [
    None, "", " \t\n\x0b", "a", "a a a a a", "a a a a a a", "A a " * 4, "x " + "b c " * 4 + "y", "b c " * 3 + "b", "é\x1cé " * 6, "a\xa0b " * 7,
    "p q r " * 4 + "p q r s " * 4, "one two three four five six seven eight " * 5, "a a a a b a a a a b a a a a b a a a a b", "w " * 30_000 + "end", " ".join(f"u{i}" for i in range(5000)),
]


def test_operator_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(module, "BATCH", 100)
    rows = [(i, t, 1, "z") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], 2, "y"), (5, TEXTS[5], 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=repr)
    quick = {14: [(0, 30_000, 1)]}
    want = []
    for i, t, *_ in rows:
        found = quick.get(i) or plain(split(t)) if i != 15 else []
        want.append((i, found, collapsed(split(t), found)))
    assert got == sorted(want, key=repr)
    assert periodic_runs(df.limit(0)).collect() == []


def test_query_against_plain_version(spark, tmp_path):
    rng = random.Random(2)
    rows = list(enumerate(TEXTS[:14]))
    for i in range(14, 160):
        rows.append((i, " ".join(f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 90)))))
    rows += [(None, "a " * 9), (3, "a " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = [], 0
    for i, t in rows:
        w = split(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j if j < a else a + (j - a) % p] for j in range(len(w))]
            planted += 1
        found = plain(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w, found))]
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert planted > 5
