import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cinderlake.llm.packing import best_fit_packing, best_fit_plan
from cinderlake.llm.tokens import SpacedTokens, default_path


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        b = min(fit, key=lambda b: b[0]) if fit else None
        if b is None:
            b = [capacity]
            bins.append(b)
        b[0] -= n
    return sorted(capacity - b[0] for b in bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_one_by_one_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else max(1, capacity // 3) for _ in range(rng.randint(0, 400))]
    plan = best_fit_plan(Counter(lengths), capacity)
    fill, rows = Counter(), Counter()
    for length, _, number, first, offset, each in sorted(plan.tolist(), key=lambda r: (-r[0], r[1])):
        rows[length] += number
        for i in range(number):
            b, at = first + i // each, offset + i % each * length
            assert fill[b] == at
            fill[b] += length
    assert rows == Counter(lengths)
    assert sorted(fill.values()) == plain_best_fit(lengths, capacity)


def test_packing_round_trip(spark):
    rng = random.Random(4)
    texts = [None, "", "Hello, world.", "x.y, z", "É́ é", "a\x1cb", "<|endoftext|> it's", "word " * 3000, "w " * 2047, "w " * 2048]
    texts += [" ".join(rng.choice(["the", "Tree,", "it's", "42", "über.", "ñandú"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want = {}
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[i, p // 2048] = (p, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == len(plain_best_fit([r.length for r in got], 2048))


def test_packing_of_nothing_and_of_equal_rows(spark):
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    same = spark.createDataFrame([(1, "a b")] * 900, "doc_id long, text string")
    got = best_fit_packing(same).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 900
    assert len({r.sequence_id for r in got}) == -(-900 // (2048 // 3))


def test_spaced_tokens_equal_whole_text():
    t = SpacedTokens(default_path("word_bpe_49k.json"))
    texts = ["A.B, c..", "don't, I'LL.", "x,,", "İs ΟΔΟΣ, ΣΑΣ.", "é, a.", "1, 2.", "a b c", "日本, 語."]
    assert t.batch(texts) == [np.asarray(t.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
