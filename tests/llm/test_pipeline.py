import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(2)

    def text(n):
        return " ".join(f"w{rng.randrange(500)}" for _ in range(n))

    rows = []
    for i in range(200):
        t = text(60)
        rows.append((i, t + (" vileword" * 6 if i % 4 == 0 else ""), "en", f"s{i % 3}", 1))
    rows += [(200 + i, rows[1][1].upper(), "en", "s1", 1) for i in range(5)]
    rows += [(300 + i, " ".join([*rows[2][1].split()[:-1], f"e{i}"]), "en", "s1", 1) for i in range(5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for i, (_, stage) in enumerate(p.STAGES):
        path = f"{tmp_path}/stage-{i}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        if i < 4:
            assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert len([i for i in ids[0] if i < 200 and i % 4 == 0]) <= 3
    assert len([i for i in ids[0] if i < 200 and i % 4]) >= 147
    assert ids[1] & {1, 200, 201, 202, 203, 204} == {204}
    assert ids[2] & {2, 300, 301, 302, 303, 304} == {2}
    assert docs.select(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert {r[0] for r in p.run(spark, str(tmp_path)).select("doc_id").collect()} == ids[4]


def test_rows_of_one_id_are_dropped_one_by_one(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (9, b.upper()), (None, c), (None, c), (7, "same"), (7, "same"), (8, "own")]
    df = lambda xs: spark.createDataFrame([(*x, "en", "s", 1) for x in xs], DOCS)
    pairs = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    got = p.drop_copies(spark, df(rows), "")
    assert got.columns == df(rows).columns
    assert pairs(got) == sorted([(5, a), (9, b.upper()), (None, c), (7, "same"), (8, "own")], key=repr)
    rows = [(5, a), (5, b), (3, a + " end"), (None, c + " end"), (None, c), (4, c), (7, "same"), (7, "same")]
    assert pairs(p.drop_near_copies(spark, df(rows), "")) == sorted([(5, b), (3, a + " end"), (4, c), (7, "same")], key=repr)


def test_stages_on_odd_rows_and_on_nothing(spark, tmp_path):
    """Nulls in any column, empty texts, ties, repeated rows, clashing columns."""
    import corpus_pipeline as p

    kind = DOCS + ", size int, keep_id int, component_id int, _row int, taken int, kept boolean"
    extra = (1, 2, 3, 4, 5, True)
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", "en", None, 2), (None, a, "en", "s", 5), (None, a.upper(), "en", None, 5), (4, a + " end", "en", "s", 5), (5, "own words", "de", "t", 9), (5, "own words", "de", "t", 9), (6, "x " * 60_000, "en", "t", None)]
    for name, part in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(*r, *extra) for r in part], kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 0)] if part else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns, ids = docs.columns, []
        for i, (_, stage) in enumerate(p.STAGES):
            path = f"{folder}/stage-{i}"
            stage(spark, docs, folder).write.parquet(path)
            docs = spark.read.parquet(path)
            ids.append(sorted((r[0] for r in docs.select("doc_id").collect()), key=str))
            if i < 4:
                assert docs.columns == columns and {tuple(r)[5:] for r in docs.collect()} <= {extra}
        if part:
            assert ids[0] == [1, 2, 3, 4, 5, 5, 6, None, None]
            assert ids[1] == [2, 3, 4, 5, 6, None]  # of the empty texts the larger id, of equal rows one
            assert ids[2] == [2, 3, 4, 5, 6]
            assert set(ids[3]) <= {4, 5, 6} and set(ids[4]) == set(ids[3])
        else:
            assert ids == [[]] * 5
