import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cinderlake.llm import ngram_join as ngram_join_module
from cinderlake.llm.graph import components
from cinderlake.llm.ngram_join import may_link, ngram_join, packed, sketch
from cinderlake.llm.shingles import shingle_sets


def shingles(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        kind = rng.randrange(5)
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(1, 120))]
        if kind == 0 and rows:
            words = edited(rng, (rng.choice(rows)[1] or "x").split() or ["x"], rng.randint(0, 3))
        elif kind == 1:
            words = common + base[: rng.randint(0, 40)]
        elif kind == 2 and rows:
            words = (rng.choice(rows)[1] or "x").split() + base[: rng.randint(0, 20)]
        else:
            words = base
        rows.append((len(rows), " ".join(words)))
    return rows


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 260)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
        assert got == plain(rows)


def test_chain_and_hot_groups(spark):
    """A group of near copies around one text, a chain of edits, and copies."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(120)]
    words = [f"k{i}" for i in range(200)]
    for i in range(120, 180):
        words = edited(rng, words, 2)
        rows.append((i, " ".join(words)))
    rows += [(i, "the same few words again and again") for i in range(180, 260)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    assert got == plain(rows)


def one_word_changed(n):
    """Near copies of a text that is absent."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    return [(i, " ".join(edited(rng, base, 1))) for i in range(n)]


def test_near_copies_of_an_absent_text_cost_their_number(spark, monkeypatch):
    made = []
    verify = ngram_join_module.verify
    monkeypatch.setattr(ngram_join_module, "verify", lambda rows, first, classes, pairs, *rest: made.append(pairs.count()) or verify(rows, first, classes, pairs, *rest))
    rows = one_word_changed(400)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain(rows)
    assert sum(made) < 30 * len(rows)  # all pairs are 79,800


def test_hot_lists_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join_module, "LIST_ROWS", 8)
    rows = one_word_changed(90) + [(i + 90, t) for i, t in corpus(4, 60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("percent", [90, 99])
def test_other_thresholds(spark, percent):
    rng = random.Random(percent)
    rows = corpus(percent, 60)
    for n in (200, 1500):
        base = [f"t{n}-{i}" for i in range(n)]
        rows += [(len(rows) + i, " ".join(edited(rng, base, i % 3))) for i in range(8)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == plain(rows, percent)


def test_length_classes_fit_their_bits():
    for percent in (50, 75, 90, 95, 99, 100):
        g = np.gcd(percent, 100)
        for n in (1, 2, 100, 10**6, 2**32 - 1):
            z = packed(n, np.arange(3), percent // g, 100 // g)
            assert (z > 0).all() and (z & 0xFFFFFFFF == n).all()


def test_edge_cases(spark):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (4, "A\x0bB"), (5, "a b c d e"), (6, "a  b c d E"), (7, "a b c d"), (8, "a\x1cb"), (9, "é É"), (10, "É É"), (11, "w " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, cls int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df).collect()}
    assert got == plain(rows)
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingle_sets_across_blocks(monkeypatch):
    import cinderlake.llm.shingles as s

    rows = [t for _, t in corpus(9, 80)] + [None, "x" * 5000]
    whole = [x.tolist() for x in shingle_sets(pa.array(rows, pa.string()))]
    monkeypatch.setattr(s, "BLOCK", 200)
    assert [x.tolist() for x in shingle_sets(pa.array(rows, pa.string()).slice(0, len(rows)))] == whole
    assert [len(x) for x in whole] == [len(shingles(t)) for t in rows]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_sketches_pass_every_link():
    rng = np.random.default_rng(5)
    kept = lost = 0
    for n in [1, 2, 3, 7, 8, 63, 64, 65, 300, 2000] * 20:
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        m = len(a) if rng.random() < 0.3 else rng.integers(0, len(a) + 1)
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[:m]], rng.integers(0, 2**64, rng.integers(0, n // 2 + 1), np.uint64))))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        link = 4 * common >= 3 * (len(a) + len(b) - common)
        passed = may_link(sketch(a), sketch(b), 3, 4)
        assert passed or not link
        kept, lost = kept + passed, lost + (not passed)
    assert kept and lost
    crowded = np.arange(40, dtype=np.uint64)
    assert sketch(crowded) == b"" and may_link(sketch(crowded), sketch(a), 3, 4)


def test_an_id_with_two_texts(spark):
    """Sets go by class, so a row that shares an id with another lends it no links."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, two + " more"), (3, one + " more"), (4, " ".join(f"c{i}" for i in range(60)))]
    got = {(r.doc_id, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_lists_of_texts_that_do_not_link_take_two_steps(spark, monkeypatch):
    """Texts that share one or two of their three passages leave lists open: one round, then the exact join."""
    steps, exact = [], []
    opened, joined = ngram_join_module._open_lists, ngram_join_module._all_pairs
    monkeypatch.setattr(ngram_join_module, "_open_lists", lambda *a: steps.append(opened(*a)) or steps[-1])
    monkeypatch.setattr(ngram_join_module, "_all_pairs", lambda *a: exact.append(1) or joined(*a))
    passages = [[f"p{i}-{j}" for j in range(40)] for i in range(8)]
    texts = [" ".join(w for p in three for w in p) for three in itertools.permutations(passages, 3)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain(rows)
    assert steps[0][2] > 4 * 4 * steps[0][1]  # too many pairs for the exact join at once
    assert len(steps) == 2 and exact == [1]


def test_joins_of_few_rows_are_broadcast(spark):
    """Rows in many small files look large to Spark, but their number is known."""
    from cinderlake.llm import common

    few = common.staged(spark.range(2_000).repartition(100), "few")
    assert "hint" in common.hint_for(few)(few)._jdf.queryExecution().logical().toString().lower()
    many = spark.range(common.FEW_ROWS + 1)
    assert common.hint_for(many)(many) is many
