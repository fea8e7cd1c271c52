"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the densities (count / number of n-grams) of the character 3-, 4- and
5-grams of the lower-cased text, hashed to 2 ** 20 places.  Over the training rows,
the ratio of an n-gram is the log of its smoothed share of toxic rows over its
share of the others; densities are multiplied by their ratios, and a logistic
regression is fitted on the products (L2, momentum gradient descent, toxic rows
weighted threefold).  N-grams in fewer than five training rows, or with a ratio
near zero, are left out.

Training reads at most ``max_rows`` labelled rows of at most ``max_chars``
characters together, in the order of a hash of their id, from all that are allowed; a
table of that many ids and labels is what is broadcast.  Counting for the ratios and
the scaled features runs in tasks; the driver gets 8 MB of counters and the few
features left of each training row, which the two bounds bound.  Scoring is one pass
without a shuffle, with 4 MB of weights, over whole texts; a long text goes through
in blocks of ``BLOCK`` characters that overlap by four, so its features cost no more
memory than the block's.

Defined results: null and empty texts get the intercept's score, like any text
too short for an n-gram; equal texts get equal scores; several labels of one id
count as toxic if any is; without labels of both kinds every score is the share
of toxic labels (0.5 without labels), at most 0.5; an empty table gives an empty
result; repeated rows are scored each; extra columns are ignored; texts of any length
are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

ORDERS = (3, 4, 5)
BITS = 20
MAX_ROWS = 12_000
MAX_CHARS = 1 << 26
TRAIN_TASKS = 12
THRESHOLD = 0.7
LEAST_ROWS = 5
LEAST_RATIO = 0.7
TOXIC_WEIGHT = 3.0
L2 = 1e-6
ROUNDS = 150
BLOCK = 1 << 17  # characters that are worked on at once
SLICE = 256  # texts that are held as Python strings at once
_MULT = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _blocks(text: str) -> Iterator[np.ndarray]:
    """The characters of a text between two spaces, lower-cased, in blocks that share the characters of n-grams across their ends."""
    step, more = BLOCK, max(ORDERS) - 1
    whole = f" {text} "
    for lo in range(0, max(1, len(whole) - min(ORDERS) + 1), step):
        yield _chars(whole[lo : lo + step + more])


def places(chars: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the hashed place of the n-gram that begins at each character."""
    a = chars.astype(np.uint64)
    g = a
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            g = g[:-1] * _MULT + a[n - 1 :]
            if n in ORDERS:
                yield (((g + np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _starting(chars: np.ndarray) -> Iterator[np.ndarray]:
    """Of a block's n-grams, those that begin before its shared end."""
    for x in places(chars):
        yield x[:BLOCK]


def _counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of a text, their counts, and the number of its n-grams."""
    if len(text) + 2 <= BLOCK:
        x = np.concatenate(list(places(_chars(f" {text} "))))
        at, n = np.unique(x, return_counts=True)
        return at, n, len(x)
    n, number = np.zeros(1 << BITS, np.int64), 0
    for block in _blocks(text):
        for x in _starting(block):
            n += np.bincount(x, minlength=1 << BITS)
            number += len(x)
    at = np.flatnonzero(n)
    return at, n[at], number


def _density(text: str, weights: np.ndarray) -> float:
    """``densities`` of one long text."""
    total, number = 0.0, 0
    for block in _blocks(text):
        for x in _starting(block):
            total += weights[x].sum(dtype=np.float64)
            number += len(x)
    return total / max(number, 1)


def densities(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum over n-grams of density times weight, for each text."""
    out = np.zeros(len(texts))
    i = 0
    while i < len(texts):
        if len(texts[i]) + 2 > BLOCK:
            out[i] = _density(texts[i], weights)
            i += 1
            continue
        parts, held, j = [], 0, i
        while j < len(texts) and held < BLOCK and len(texts[j]) + 2 <= BLOCK:
            parts.append(_chars(f" {texts[j]} "))
            held += len(parts[-1])
            j += 1
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        total, number = np.zeros(j - i), np.zeros(j - i)
        for n, at in zip(ORDERS, places(np.concatenate(parts))):
            sums = np.concatenate(([0.0], np.cumsum(weights[at], dtype=np.float64)))
            last = np.maximum(np.minimum(ends - n + 1, len(at)), starts)
            first = np.minimum(starts, len(at))
            last = np.maximum(last, first)
            last = np.minimum(last, len(at))
            total += sums[last] - sums[first]
            number += last - first
        out[i:j] = total / np.maximum(number, 1)
        i = j
    return out


def _nb_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by place, of either label."""
    n = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            n[int(toxic.as_py())][_counts(text.as_py() or "")[0]] += 1
    for toxic in (0, 1):
        if n[toxic].any():
            for block, part in enumerate(n[toxic].reshape(64, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([toxic], pa.int32()), pa.array([block], pa.int32()), pa.array([part.astype("<i4").tobytes()], pa.binary())], ["toxic", "block", "counts"])


def _sum_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << BITS) // 64, np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<i4")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.astype("<i4").tobytes()], pa.binary())], ["toxic", "block", "counts"])


def _features(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.frombuffer(ratios.value, "<f4")
        for batch in batches:
            for text, toxic, doc in zip(batch.column(0), batch.column(1), batch.column(2)):
                at, n, number = _counts(text.as_py() or "")
                keep = r[at] != 0
                values = (n[keep] / max(1, number) * r[at[keep]]).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()], pa.int64()), pa.array([int(toxic.as_py())], pa.int32()), pa.array([at[keep].astype("<i4").tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())],
                    ["doc_id", "toxic", "places", "x"],
                )

    return run


def _logistic(rows: list, size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept.  ``rows``: (label, places, values)."""
    y = np.asarray([r[0] for r in rows], np.float64)
    at = np.concatenate([r[1] for r in rows])
    x = np.concatenate([r[2] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    norm = np.sqrt(np.bincount(row, weights=x * x, minlength=len(rows)).mean()) or 1.0
    x /= norm
    cost = np.where(y == 1, TOXIC_WEIGHT, 1.0) / len(y)
    w, b = np.zeros(len(used)), 0.0
    vw, vb, rate, momentum = np.zeros(len(used)), 0.0, 10.0, 0.9
    for _ in range(ROUNDS):
        z = np.clip(np.bincount(row, weights=w[at] * x, minlength=len(rows)) + b, -30, 30)
        e = (1 / (1 + np.exp(-z)) - y) * cost
        gw, gb = np.bincount(at, weights=x * e[row], minlength=len(used)) + L2 * w, e.sum()
        vw, vb = momentum * vw - rate * gw, momentum * vb - rate * gb
        w, b = w + momentum * vw - rate * gw, b + momentum * vb - rate * gb
    out = np.zeros(size)
    out[used] = w / norm
    return out, float(b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[bytes, float]:
    """``labels``: ``doc_id, toxic``, the rows that may be learned from.  Returns float32 weights by place, and the intercept."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "doc_id")
    rows = staged(rows.repartition(TRAIN_TASKS), "toxic-rows")  # few tasks, as each counts in a table of its own
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > max_chars:
        order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of the sample's ids only
        upto = rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).withColumn("upto", F.sum("n").over(order))
        rows = staged(rows.join(F.broadcast(upto.where(F.col("upto") <= max_chars).select("doc_id")), "doc_id").select("text", "toxic", "doc_id"), "toxic-rows")
    number = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    size = 1 << BITS
    if len(number) < 2:
        share = number.get(1, 0) / max(1, sum(number.values())) if number else 0.5
        share = min(max(share, 1e-6), 0.5)
        return np.zeros(size, "<f4").tobytes(), float(np.log(share / (1 - share)))
    counts = np.zeros((2, 64, size // 64), np.int64)
    blocks = rows.mapInArrow(_nb_counts, "toxic int, block int, counts binary").groupBy("toxic", "block")
    for r in blocks.applyInArrow(_sum_counts, "toxic int, block int, counts binary").collect():
        counts[r["toxic"], r["block"]] = np.frombuffer(r["counts"], "<i4")
    neg, pos = counts.reshape(2, size)
    ratios = np.log((pos + 1) / (number[1] + 2)) - np.log((neg + 1) / (number[0] + 2))
    ratios[(pos + neg < LEAST_ROWS) | (np.abs(ratios) < LEAST_RATIO)] = 0
    ratios = ratios.astype("<f4")
    shared = spark.sparkContext.broadcast(ratios.tobytes())
    found = rows.mapInArrow(_features(shared), "doc_id long, toxic int, places binary, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["places"], r["x"]))  # sums of floats don't depend on the order of tasks
    kept = [(r["toxic"], np.frombuffer(r["places"], "<i4"), np.frombuffer(r["x"], "<f4")) for r in found]
    weights, intercept = _logistic(kept, size)
    return (weights * ratios).astype("<f4").tobytes(), intercept


def scorer(spark: SparkSession, model: tuple[bytes, float]):
    """A column function: text to score."""
    shared, intercept = spark.sparkContext.broadcast(model[0]), model[1]

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = np.frombuffer(shared.value, "<f4")
        for texts in batches:
            z = np.full(len(texts), intercept)
            for lo in range(0, len(texts), SLICE):
                z[lo : lo + SLICE] += densities([t or "" for t in texts.slice(lo, SLICE).to_pylist()], weights)
            yield pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9))

    return score


def learnable(labels: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 3 is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, train(docs, learnable(table(spark, sf_dir, "labels"))))
    return docs.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in their own columns."""
    score = scorer(docs.sparkSession, train(docs, learnable(labels)))
    return docs.where(score("text") < threshold)
