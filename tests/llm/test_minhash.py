import random

import numpy as np
import pytest

from cinderlake.llm import minhash as module
from cinderlake.llm.minhash import band_hashes, minmax_dedup, op13_minmax_dedup, signatures
from cinderlake.llm.ngram_join import parity

from .test_ngram_join import corpus, edited


def shingles(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def plain(rows, percent=85, k=3):
    sets = {i: shingles(t, k) for i, t in rows}
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
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def found(spark, rows, **options):
    return [tuple(r) for r in minmax_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options).collect()]


def groups(seed):
    """Originals, their edits (some link with the original only), growing prefixes, copies."""
    rng = random.Random(seed)
    rows = [t for _, t in corpus(seed, 60)]
    for n in (12, 40, 150, 900):
        base = [f"g{n}-{i}" for i in range(n)]
        rows += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(0, max(1, n // 25)))) for _ in range(14)]
        rows += [" ".join(base[: n - i]) for i in range(0, n // 3, max(1, n // 30))]
    rows += ["a short one", "A  Short\tone", "two words", "one"] * 4
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = groups(seed)
    got = found(spark, rows)
    assert len(got) == len(rows) and set(got) == plain(rows)


def test_other_thresholds(spark):
    rows = groups(3)
    assert set(found(spark, rows, k=2, percent=70, bands=40, rows_a_band=3)) == plain(rows, 70, 2)


def test_near_copies_of_an_absent_text(spark, monkeypatch):
    """Edits of a text that is absent: a few pairs a document are verified, not all."""
    from cinderlake.llm import ngram_join

    made, verify = [], ngram_join.verify
    for owner in (ngram_join, module):
        monkeypatch.setattr(owner, "verify", lambda rows, first, classes, pairs, *rest: made.append(pairs.count()) or verify(rows, first, classes, pairs, *rest))
    rng, base = random.Random(5), [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(300)]
    assert set(found(spark, rows)) == plain(rows)
    assert 0 < sum(made) < 30 * len(rows)


def test_groups_under_the_threshold_are_not_paired(spark, monkeypatch):
    """Texts that share most of their bands but don't link: their rarest shingles keep them apart."""
    from cinderlake.llm import ngram_join

    made, verify = [], ngram_join.verify
    for owner in (ngram_join, module):
        monkeypatch.setattr(owner, "verify", lambda rows, first, classes, pairs, *rest: made.append(pairs.count()) or verify(rows, first, classes, pairs, *rest))
    rng, base = random.Random(6), [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 4))) for i in range(240)]
    rows += [(240 + i, rows[i][1] + " end") for i in range(20)]
    assert set(found(spark, rows)) == plain(rows)
    assert sum(made) < 4 * len(rows)  # all pairs are 33,670


def test_odd_rows(spark, tmp_path):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (4, "A\x0bB"), (5, "a b c"), (6, "a  B c"), (7, "a\x1cb"), (8, "w " * 30_000), (9, "é É x"), (10, "É É x"), (11, "x " * 7), (11, "y z q")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bands string, kept int")
    got = [tuple(r) for r in minmax_dedup(df).collect()]
    assert len(got) == len(rows)
    assert {r for r in got if r[0] != 11} == {r for r in plain(rows) if r[0] != 11}
    assert sorted(r for r in got if r[0] == 11) == [(11, 1, 11, True), (11, 1, 11, True)]
    assert minmax_dedup(df.limit(0)).collect() == []
    nameless = [(None, "p q r s"), (None, "p q r s"), (3, "m n o"), (None, "m n o")]
    assert sorted(found(spark, nameless), key=repr) == sorted([(None, 2, None, True)] * 2 + [(3, 1, 3, True), (None, 1, 3, False)], key=repr)
    spark.createDataFrame(groups(4), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op13_minmax_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {tuple(r) for r in out.collect()} == plain(groups(4))


def test_signature_values_agree_as_often_as_sets_are_alike():
    """Minima and maxima estimate the similarity without bias, and with less variance than as many minima."""
    rng = np.random.default_rng(1)
    for common, own in ((80, 20), (300, 300), (17, 3)):
        errors = {"both": [], "minima": []}
        for _ in range(60):
            x = rng.integers(0, 2**64, common + 2 * own, np.uint64)
            signed = signatures([np.sort(x[: common + own]), np.sort(np.concatenate((x[:common], x[common + own :])))], 128)
            same = signed[:, 0] == signed[:, 1]
            true = common / (common + 2 * own)
            errors["both"].append(np.concatenate((same[:64], same[128:192])).mean() - true)
            errors["minima"].append(same[:128].mean() - true)
        assert abs(np.mean(errors["both"])) < 0.025
        assert np.var(errors["both"]) < 1.3 * np.var(errors["minima"])


def test_bands_hold_one_value_of_a_permutation():
    for bands, rows in ((32, 5), (32, 4), (16, 6)):
        n = (bands * rows + 1) // 2
        ids = np.tile(np.arange(n, dtype=np.uint64), 2)[:, None]
        values = np.concatenate((ids[:n], np.roll(ids[n:], 1, axis=0)))
        for b in range(bands):
            own = [int(values[b + j * bands][0]) for j in range(rows)]
            assert len(set(own)) == rows
        one = band_hashes(signatures([np.arange(9, dtype=np.uint64), np.arange(9, dtype=np.uint64)], n), bands, rows)
        assert one.shape == (2, bands) and (one[0] == one[1]).all() and len(set(one[0].tolist())) == bands


def test_parities_bound_the_elements_of_one_set_only():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 400):
        for _ in range(40):
            x = rng.integers(0, 2**64, n + 20, np.uint64)
            a, b = x[: n + rng.integers(0, 20)], x[rng.integers(0, min(n, 12)) :]
            differ = len(np.setxor1d(a, b))
            bits = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(parity(a), parity(b)))
            assert bits <= differ and (bits - differ) % 2 == 0
    assert parity(x) == parity(rng.permutation(x))


def test_long_texts_are_signed_in_parts(spark, monkeypatch):
    rows = groups(6)
    whole = sorted(found(spark, rows))
    monkeypatch.setattr(module, "BATCH", 50)
    assert sorted(found(spark, rows)) == whole
