"""Importance resampling towards a target distribution of hashed n-grams.

Documents are weighed by how much likelier the target makes their n-grams than the
corpus does, and drawn without replacement by weight plus seeded Gumbel noise.

1. A task puts the words of its documents, block by block, into one sequence of word
   ids with a separator after each document, and sorts its places by their next
   ``max_n`` words (prefix doubling): the suffix array of the block, as deep as
   n-grams reach.  The common prefixes of neighbours (LCP, up to ``max_n``) cut it into
   runs: for each n, places that share n words stand together.  Each run's n-gram is
   hashed once, and its bucket is scattered back to all places of the run.
2. The buckets of each document are staged (two bytes an n-gram), beside sums of
   buckets by task, which give the counts of the corpus; the target likewise.
3. A bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), from its counts t
   and s and the sums T and S over B buckets.  A document's weight is the floored mean
   of its gains.  The table of B gains is the only thing that is broadcast.
4. Scores (weight plus noise) are range-partitioned and sorted with their ids; the rows
   of each partition are counted, and a row's rank is its place plus the counts before.

A block holds about ``BLOCK`` bytes of text, or one longer text, in under thirty
times its size.  No task sorts or counts more than a block, or its share of narrow rows.

Defined results: a null or empty text, or one without words, has no n-grams and weight
0; it is drawn only if ``least_words`` is 0.  Ties go to the smaller id; a null id sorts
above all others, its noise is that of an empty id; repeated rows are drawn one by one,
in any order; an empty corpus or target gives gains from counts of 0; extra columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, tasks_for

BUCKETS, MAX_N, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Bytes of text in a block, about.
BLOCK = 1 << 22
#: Counters in a row of sums.
SUMS = 1000
#: A-Z to lower case; of the other bytes, what is no digit, lower-case letter or part of a longer character parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``ids`` sorted by their next ``depth`` ids, and how many of these each shares with the place before it.

    Id 0 is a separator: nothing is shared from there on.
    """
    n = len(ids)
    rank, reach = ids.astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        # What follows a separator doesn't count.
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)
        reach += step
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    ahead = np.concatenate((ids, np.zeros(depth, ids.dtype)))
    same = np.ones(max(0, n - 1), bool)
    for j in range(depth):
        here = ahead[order + j]
        same &= (here[1:] == here[:-1]) & (here[1:] != 0)
        shared[1:] += same
    return order, shared


def bucketed(texts: list[bytes], max_n: int, buckets: int) -> tuple[list[int], list[np.ndarray]]:
    """Of each text: the number of its words, and the buckets of its n-grams, n by n."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        own = t.translate(_FOLD).split()
        sizes.append(len(own))
        words += own
        words.append(b"")
    numbers = {b"": 0}
    ids = np.asarray([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    ends = np.cumsum(np.asarray(sizes, np.int64) + 1) - 1
    left = np.repeat(ends, np.asarray(sizes, np.int64) + 1) - np.arange(len(ids))  # words from a place to its document's end
    order, shared = suffix_order(ids, max_n)
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for n in range(1, max_n + 1):
        whole = left[order] >= n
        places, heads = order[whole], shared[whole] < n
        if not len(places):
            break
        hashed = [zlib.crc32(b" ".join(words[p : p + n])) % buckets for p in places[heads].tolist()]
        of = np.zeros(len(ids), kind)
        of[places] = np.asarray(hashed, kind)[np.cumsum(heads) - 1]
        for d, (size, end) in enumerate(zip(sizes, ends.tolist())):
            if size >= n:
                found[d].append(of[end - size : end - n + 1])
    return sizes, [np.concatenate(f) if f else np.zeros(0, kind) for f in found]


FEATURES = "doc_id long, n_words long, n_features long, buckets binary, first int, counts array<long>"


def _features(max_n: int, buckets: int):
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)

        def out(ids, texts):
            sizes, found = bucketed(texts, max_n, buckets)
            for f in found:
                np.add(total, np.bincount(f, minlength=buckets), out=total) if len(f) > buckets else np.add.at(total, f, 1)
            m = len(sizes)
            columns = [ids, pa.array(sizes, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts, held, at = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                held += len(texts[-1])
                if held > BLOCK:
                    yield out(batch.column(0).slice(at, len(texts)), texts)
                    texts, held, at = [], 0, i + 1
            if texts:
                yield out(batch.column(0).slice(at, len(texts)), texts)
        if total.any():
            firsts = range(0, buckets, SUMS)
            m = len(firsts)
            columns = [*(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.binary()), pa.array(firsts, pa.int32()), pa.array([total[f : f + SUMS] for f in firsts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def features(docs: DataFrame, max_n: int, buckets: int, tag: str) -> DataFrame:
    """``docs``: ``doc_id, text``.  Rows of documents with the buckets of their n-grams, and rows of sums (``first`` is not null), staged."""
    return staged(docs.mapInArrow(_features(max_n, buckets), FEATURES), tag)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams each bucket has; as many numbers come to the driver as there are buckets."""
    sums = found.where("first is not null").select("first", F.posexplode("counts").alias("i", "n")).groupBy((F.col("first") + F.col("i")).alias("bucket")).agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.asarray([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighed(table_of_gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.frombuffer(table_of_gains.value, "<i8")
        kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")
        for batch in batches:
            sums = [int(gain[np.frombuffer(x.as_buffer(), kind)].sum()) for x in batch.column(3)]
            weights = [s // n if n else 0 for s, n in zip(sums, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(rows: DataFrame, *order) -> DataFrame:
    """Adds ``rank``, from 1, in the order given.  Rows are dealt and sorted by ranges; only counts of partitions meet on the driver."""
    if "rank" in rows.columns or "_place" in rows.columns:
        raise ValueError("rows have a column rank or _place")
    dealt = rows.repartitionByRange(tasks_for(rows), *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    before, offsets = 0, []
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part long, before long"))  # a row for each partition
    return dealt.withColumn("part", part).join(starts, "part").select(*rows.columns, (F.col("before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, max_n: int = MAX_N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank``.  ``percent`` of the documents with enough words
    are drawn, by score; the others' rank is null.  ``target`` needs the text column only."""
    spark = docs.sparkSession
    found = features(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), max_n, buckets, "resample-features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), max_n, buckets, "resample-target")
    shared = spark.sparkContext.broadcast(gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets)).astype("<i8").tobytes())
    weighed = found.where("first is null").mapInArrow(_weighed(shared), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(weighed.withColumn("score", F.col("weight") + noise), "resample-scored")
    order = ranked(scored.where(F.col("n_words") >= least_words), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    few = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    size = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    every = order.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank"))).unionByName(few)
    return every.select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), c AS (
  SELECT x, xor(list_reduce(list_transform(range(1, 2 * strlen(x), 2), lambda i: ('0x' || substr(hex(x), i, 2))::UBIGINT),
      lambda crc, b: list_reduce(range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(crc, b)), 4294967295::UBIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT x FROM w)
), b AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM w JOIN c USING (x) GROUP BY bucket
), n AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM b),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS gain FROM b, n
), f AS (
  SELECT id AS doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM w JOIN c USING (x) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id
), r AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN f USING (doc_id)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS size FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * size // 100 THEN place END AS rank FROM o
"""
