"""Near duplicates by min-max hashing, with links confirmed on full sets.

A permutation of a document's shingle hashes gives two signature values, its least and
its greatest element.  Each agrees between two sets with a probability of their Jaccard
similarity, so a signature takes half as many permutations as values; the two are
negatively correlated, which lowers the variance of their mean.  A band takes its values
from different permutations, minima and maxima mixed, so they agree independently.

1. One pass over the texts gives each document's set size, its class (documents of one
   set are one class, whatever the number of copies), a sketch of the set, and a hash of
   each band, once per class and task.
2. A band hash is a list of classes.  Lists of one class are dropped after a count.
3. The class that meets the most others in its lists comes first: among near copies it
   is the text that they were made from.  Each row of a list is paired with the list's
   first class, and each class keeps the pair that the most lists share.
4. These pairs are verified on whole sets and joined to components.
5. Lists in which several components are left are open: mostly texts that are alike, but
   less than the threshold asks for.  Pairing all rows of such a list would cost its
   square.  Instead its classes are put in lists by their rarest shingles (the prefixes
   of the n-gram join, whose shingles are counted among these classes alone), which every
   link between two of them shares, and what a group of unlike texts doesn't share.
   These lists are joined as there (``ngram_join.settle``), with one more filter, on 256
   parities of each set.  No list is capped, and each pair is verified once.

Two documents that link are missed only if no band agrees.  With 24 bands of 4 values
(48 permutations) that has a probability of (1 - 0.85 ** 4) ** 24, about 2 in 10 ** 8 at
the threshold, and less above it; a longer way round through other links also counts.
A pair under the threshold never links.

Defined results: null, empty and blank texts have no shingles, link with nothing and
are components of their own; a text of fewer than ``k`` words has one shingle, its
whole word sequence; ties and repeated rows are copies of one class, and rows of one id
are kept or dropped together; a row with a null id is kept if its component has no id;
an empty table gives an empty result; extra columns are ignored; texts of any length
are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .graph import components
from .ngram_join import _chosen_counts, _met, bitmap_of, by_document, classes_of, packed, parity, prefix_lists, settle, sketch, verify
from .shingles import fingerprint, mix64, shingle_sets

BANDS, ROWS = 24, 4
#: Rows of an open list that the first round pairs each row with.  At a high threshold the filters leave few of these pairs.
WIDTH = 64
#: Shingles that a task signs at once, about; a longer text is signed in parts of as many.
BATCH = 1 << 16
SEED = 13


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of n permutations of 64-bit numbers."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minima, then maxima, of ``n`` permutations of each set (none empty): an array of 2 n rows and a column a set."""
    factors, addends = permutations(n)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    every = np.concatenate(sets)
    out = np.empty((2 * n, len(sets)), np.uint64)
    moved = np.empty_like(every)
    with np.errstate(over="ignore"):
        for j in range(n):
            np.multiply(every, factors[j], out=moved)
            np.add(moved, addends[j], out=moved)
            np.minimum.reduceat(moved, starts, out=out[j])
            np.maximum.reduceat(moved, starts, out=out[n + j])
    return out


def band_hashes(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of each set: an array of a row a set.

    Band b takes value b of every ``bands`` values; maxima are moved on by one permutation, so that no band has
    the minimum and the maximum of one.
    """
    n = len(signed) // 2
    values = np.concatenate((signed[:n], np.roll(signed[n:], 1, axis=0)))
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (1, signed.shape[1]))
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + values[j * bands : (j + 1) * bands])
    return out.T


def _signed(k: int, num: int, den: int, bands: int, rows: int):
    n_permutations = (bands * rows + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _met()

        def hashes(sets: list[np.ndarray]) -> list[bytes]:
            """Of the sets, signed together; a long one in parts, whose minima and maxima are merged."""
            parts = [s[i : i + BATCH] for s in sets for i in range(0, len(s), BATCH)]
            signed = np.empty((2 * n_permutations, len(parts)), np.uint64)
            at = 0
            while at < len(parts):
                end, held = at, 0
                while end < len(parts) and (end == at or held + len(parts[end]) <= BATCH):
                    held += len(parts[end])
                    end += 1
                signed[:, at:end] = signatures(parts[at:end], n_permutations)
                at = end
            starts = np.concatenate(([0], np.cumsum([-(-len(s) // BATCH) for s in sets])[:-1])).astype(np.int64)
            n = n_permutations
            whole = np.concatenate((np.minimum.reduceat(signed[:n], starts, axis=1), np.maximum.reduceat(signed[n:], starts, axis=1)))
            return list(band_hashes(whole, bands, rows).view(np.int64))

        def out(ids, sizes, classes, places, sketches, bits, fresh):
            found = [None] * len(sizes)
            if fresh:
                for i, h in zip(fresh, hashes(list(fresh.values()))):
                    found[i] = h
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(places, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cls", "np", "sketch", "bits", "bands"])

        none = np.zeros(1, np.int64)
        for batch in batches:
            rows_held: tuple[list, ...] = ([], [], [], [], [])
            fresh, held, at = {}, 0, 0
            for i, s in enumerate(shingle_sets(batch.column(1), k)):
                c = fingerprint(s) if len(s) else None
                for x, v in zip(rows_held, (len(s), c, int(packed(len(s), none, num, den)[0]) if len(s) else None, sketch(s) if len(s) else None, parity(s) if len(s) else None)):
                    x.append(v)
                if len(s) and not met(c):
                    fresh[i - at] = s
                    held += len(s)
                if held > BATCH:
                    yield out(batch.column(0).slice(at, i + 1 - at), *rows_held, fresh)
                    rows_held, fresh, held, at = ([], [], [], [], []), {}, 0, i + 1
            if rows_held[0]:
                yield out(batch.column(0).slice(at, len(rows_held[0])), *rows_held, fresh)

    return run


def first_pairs(posts: DataFrame) -> DataFrame:
    """Of each class, the pair (``a, b``) with a list's first class that the most lists share.  ``posts``: ``h, cls, np, met`` (classes of the list)."""
    degrees = staged(posts.groupBy("cls").agg(F.sum("met").alias("degree")), "minmax-degrees")
    heads = posts.join(degrees, "cls").groupBy("h").agg(F.max(F.struct("degree", "cls")).alias("head"))
    heads = staged(heads.select("h", F.col("head.cls").alias("a")), "minmax-heads")
    pairs = posts.join(heads, "h").where("a <> cls").groupBy("a", F.col("cls").alias("b")).count()
    return staged(pairs.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b"), "minmax-pairs")


def minmax_dedup(docs: DataFrame, k: int = 3, percent: int = 85, bands: int = BANDS, rows_a_band: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    g = math.gcd(percent, 100)
    num, den = percent // g, 100 // g
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = staged(rows.mapInArrow(_signed(k, num, den, bands, rows_a_band), "doc_id long, n long, cls long, np long, sketch binary, bits array<long>, bands array<long>"), "minmax-first")
    members = first.select("doc_id", "n", "cls")
    classes = classes_of(members, "minmax")
    signed = staged(first.where("bands is not null").groupBy("cls").agg(F.first("np").alias("np"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "minmax-signed")
    posts = signed.select(F.explode("bands").alias("h"), "cls", "np")
    lists = staged(posts.groupBy("h").agg(F.count("*").alias("met")).where("met > 1"), "minmax-lists")
    posts = staged(posts.join(lists, "h"), "minmax-posts")
    pairs = first_pairs(posts)
    comp = components(verify(rows, first, classes, pairs, k, num, den, "minmax-0"), "minmax-comp")
    found = posts.join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = found.groupBy("h").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("h")
    left = staged(posts.join(mixed, "h", "left_semi").select("cls").distinct().join(classes.select("cls", "key"), "cls"), "minmax-left")
    if not left.isEmpty():
        wanted = bitmap_of(left.select("key"))
        blocks = rows.mapInArrow(_chosen_counts(k, wanted), "block int, counts binary")
        posts, more = prefix_lists(rows, blocks, k, num, den, "minmax", wanted)
        done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        comp = settle(rows, first, classes, posts, more, k, num, den, "minmax", (comp, done), WIDTH, signed.select("cls", "bits"))
    return by_document(members, classes, comp, "minmax").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: States the links exactly, from all pairs of documents that share a shingle.
OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g
  FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * c >= 85 * (p.n + q.n - c)
), r AS (
  SELECT a AS doc, a AS reach FROM e UNION SELECT r.doc, e.b FROM r JOIN e ON e.a = r.reach
), m AS (SELECT doc, min(reach) AS c FROM r GROUP BY doc)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.c, n.doc_id) AS component_id, n.doc_id = coalesce(m.c, n.doc_id) AS kept FROM n LEFT JOIN m ON m.doc = n.doc_id
"""
