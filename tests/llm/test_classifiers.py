import math
import random
from collections import Counter

from cinderlake.llm import toxicity, url_filter


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(7)
    syllables = "ta re mi on el su ka no".split()

    def text(toxic):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyterm"]))
        return " ".join(words)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows[:600]], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]] + [(1, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    score = toxicity.scorer(spark, model)
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x"), (1003, "re mi on " * 30_000), (1004, "re mi on " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in docs.union(extra).select("doc_id", score("text").alias("s")).collect()}
    wrong = [i for i, _, y in rows[400:] if (got[i] >= 0.7) != bool(y)]
    assert len(wrong) <= 4
    assert got[1000] == got[1001] < 0.7 and got[1003] == got[1004] < 0.7
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns


def test_densities_equal_a_plain_sum():
    import numpy as np

    rng = np.random.default_rng(1)
    w = rng.normal(size=1 << toxicity.BITS)
    texts = ["", "a", "ab", "Hello there", "é" * 50, "x y " * 300]
    want = []
    for t in texts:
        at, n, number = toxicity._counts(t)
        want.append((w[at] * n).sum() / max(1, number))
    assert np.allclose(toxicity.densities(texts, w), want)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights, intercept = toxicity.train(docs, none)
    assert intercept == 0.0 and not any(weights)
    assert toxicity.keep_clean(docs, none).count() == 2
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, one).count() == 2


def test_urls(spark):
    urls = {
        "http://WWW.Example.ORG/es/1": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2#t": ("example.org", "/en/2", "org/", "allow"),
        "http://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"),
        "http://a.com/de/x/://": ("a.com", "/de/x/://", "com/de/", "block"),
        "http://xcom/de/": ("xcom", "/de/", None, None),
        "http://foo.org": ("foo.org", "", None, None),
        "http://foo.org?a/b": ("foo.org", "", None, None),
        "foo.org/es/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://É.ORG/É": ("É.org", "/É", "org/", "allow"),
        "http://casino-bets.net/en/1": ("casino-bets.net", "/en/1", None, "block"),
        "http://city-library.net/en/1": ("city-library.net", "/en/1", None, "allow"),
    }
    rows = list(enumerate(urls))
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    for i, u in rows:
        host, path, rule, verdict = urls[u]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert verdict is None or r.verdict == verdict, u
        if u:
            assert url_filter.split_url(u) == (host, path)
    assert url_filter.url_filter(df.limit(0)).collect() == []


def test_url_classifier_on_held_out_rows():
    import numpy as np

    rows = url_filter.labelled_urls()
    w, b = url_filter.train([r for i, r in enumerate(rows) if i % 4])
    right = 0
    for u, y in rows[::4]:
        at = url_filter.features(*url_filter.split_url(u))
        right += (w[at].sum() / np.sqrt(len(at)) + b >= 0) == bool(y)
    assert right >= 0.95 * len(rows[::4])


def _grams(text):
    t = f" {text.lower()} "
    return Counter(t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1))


def _plain_toxicity(rows, asked):
    """Naive Bayes ratios and logistic regression by dictionaries of n-grams."""
    seen = [(_grams(text), label) for text, label in rows]
    number = Counter(label for _, label in seen)
    df = {label: Counter(g for c, y in seen if y == label for g in c) for label in (0, 1)}
    ratio = {}
    for g in set(df[0]) | set(df[1]):
        r = math.log((df[1][g] + 1) / (number[1] + 2)) - math.log((df[0][g] + 1) / (number[0] + 2))
        if df[0][g] + df[1][g] >= toxicity.LEAST_ROWS and abs(r) >= toxicity.LEAST_RATIO:
            ratio[g] = r

    def features(c):
        return {g: n / max(1, sum(c.values())) * ratio[g] for g, n in c.items() if g in ratio}

    xs, ys = [features(c) for c, _ in seen], [y for _, y in seen]
    norm = math.sqrt(sum(v * v for x in xs for v in x.values()) / len(xs)) or 1.0
    w, vw, b, vb = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0
    for _ in range(toxicity.ROUNDS):
        gw, gb = {g: toxicity.L2 * w[g] for g in w}, 0.0
        for x, y in zip(xs, ys):
            z = sum(w[g] * v / norm for g, v in x.items()) + b
            e = (1 / (1 + math.exp(-z)) - y) * (toxicity.TOXIC_WEIGHT if y else 1.0) / len(ys)
            gb += e
            for g, v in x.items():
                gw[g] += e * v / norm
        vb = 0.9 * vb - 10.0 * gb
        b += 0.9 * vb - 10.0 * gb
        for g in w:
            vw[g] = 0.9 * vw[g] - 10.0 * gw[g]
            w[g] += 0.9 * vw[g] - 10.0 * gw[g]
    return [1 / (1 + math.exp(-(sum(w[g] * v / norm for g, v in features(_grams(t)).items()) + b))) for t in asked]


def test_toxicity_equals_a_plain_classifier(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["ta", "Rem", "ion"] + ["vile"] * (i % 3 == 0)) for _ in range(rng.randint(1, 12))), int(i % 3 == 0)) for i in range(45)]
    asked = [t for t, _ in rows] + ["", "x", "vile vile", "ta vile ion new"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    score = toxicity.scorer(spark, toxicity.train(docs, labels))
    got = [r.s for r in docs.select("doc_id", score("text").alias("s")).orderBy("doc_id").collect()]
    want = _plain_toxicity(rows, asked)
    assert max(want) - min(want) > 0.5
    assert all(abs(g - w) < 1e-4 for g, w in zip(got, want)), [(g, w) for g, w in zip(got, want) if abs(g - w) >= 1e-4]


def test_url_classifier_on_held_out_words_and_hosts():
    """Words and host shapes that training hasn't seen.  Unseen unwanted words are not known to it; nothing wanted may be blocked."""
    import numpy as np

    words = [(w, 1) for w in url_filter.UNWANTED] + [(w, 0) for w in url_filter.WANTED]
    plain = [x + y for x in url_filter.TRIGRAMS for y in url_filter.TRIGRAMS if x != y]
    known, missed, blocked = [], [], []
    for fold in range(3):
        held = {w for i, (w, _) in enumerate(words) if i % 3 == fold}
        hosts = [s for i, s in enumerate(url_filter.SHAPES) if i % 3 == fold]
        rest = [s for s in url_filter.SHAPES if s not in hosts]
        train = [(s.format(x, 100 + i), y) for i, (x, y) in enumerate(words) if x not in held for s in rest]
        train += [(rest[i % len(rest)].format(x, 100 + i), 0) for i, x in enumerate(plain) if i % 3 != fold]
        w, b = url_filter.train(train)
        for x, y in words:
            for s in hosts:
                at = url_filter.features(*url_filter.split_url(s.format(x, 7)))
                block = 1 / (1 + np.exp(-(w[at].sum() / np.sqrt(len(at)) + b))) >= url_filter.THRESHOLD
                (blocked if y == 0 else missed if x in held else known).append(bool(block))
    assert sum(blocked) <= 0.1 * len(blocked)
    assert sum(known) >= 0.7 * len(known)
    print("unseen words blocked:", sum(missed), "of", len(missed), "known:", sum(known), "of", len(known), "wanted blocked:", sum(blocked), "of", len(blocked))
