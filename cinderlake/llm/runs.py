"""Periodic runs of words by a suffix automaton with merged end-position sets.

A run of a word sequence is a stretch with smallest period q (words q apart are
identical) that no neighbouring word extends.  Only runs of at least ``min_length``
words and ``min_exponent`` (2 at least) periods are returned.

1. Words become numbers.  A window of g words that lies in a wanted run occurs again
   q words away in the same run (``window_of`` gives the largest such g), so stretches
   in which every window occurs again hold all wanted runs whole.  One vectorised
   count finds them; most texts have none and are done.
2. The suffix automaton of a stretch is built.  Its states are visited from the
   longest to the shortest, and each hands its end positions on to its suffix link:
   the smaller of two ordered sets is merged into the larger one.
3. Where a position a meets its neighbour b of the other set at a state of length
   ``reach``, the words up to a and up to b share their last ``reach`` words and no
   more.  If b - a <= reach, that seeds a square of period b - a; the stretch of
   reach + b - a words up to b has this period, and doesn't extend to the left.  It
   is a run if the words after a and b differ.  Where neighbours were neighbours only
   until a third position came, the run was also found with its smaller period, which
   is kept.

Every run of exponent 2 or more is found: let its end be b and its period q.  No
occurrence of its first length - q words ends between b - q and b, or it would have a
smaller period, so these two positions are neighbours where their sets first meet.

Merging moves each position O(log n) times; a set is a list of short sorted blocks, so
a very long text costs no long moves.

Defined results: a null, empty or blank text has no words and no runs, and collapses
to the empty text; repeated rows and null ids are rows of their own; an empty table
gives an empty result; extra columns are ignored; a text of any length is worked on
whole, in one task that holds its words and the automaton of one stretch (about 1 KB
a word of the stretch).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Positions in a block of an ordered set, at most.
BLOCK = 512
#: Bytes of collapsed text in a batch that a task returns, about.
BATCH = 1 << 22
#: Rounds in which stretches are narrowed; more only save work.
ROUNDS = 8
_first = itemgetter(0)


def window_of(min_length: int, min_exponent: int) -> int:
    """Largest g so that each window of g words of a wanted run of any period q occurs again q words before or after, within the run."""
    return min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 1))


def stretches(ids: np.ndarray, g: int, least: int) -> list[tuple[int, int]]:
    """Places (from, to) that hold all runs: every window of g words in them occurs again in them."""
    out, todo = [], [(0, len(ids), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < least:
            continue
        m = hi - lo - g + 1
        hashes = ids[lo : lo + m].astype(np.uint64)
        for j in range(1, g):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[lo + j : lo + j + m].astype(np.uint64)
        _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        again = np.zeros(m + 2, np.int8)
        again[1:-1] = counts[which] > 1
        if depth == ROUNDS or again[1:-1].all():
            out.append((lo, hi))
            continue
        edges = np.flatnonzero(np.diff(again)).tolist()
        todo += [(lo + a, lo + b + g - 1, depth + 1) for a, b in zip(edges[::2], edges[1::2])]
    return out


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state of the suffix automaton: its length, its suffix link, and the end of the prefix that made it (-1: a clone)."""
    length, link, end, following = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        state = len(length)
        length.append(i + 1)
        end.append(i)
        following.append({})
        p = last
        while p >= 0 and w not in following[p]:
            following[p][w] = state
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = following[p][w]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                clone = state + 1
                link.append(clone)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                following.append(following[q].copy())
                while p >= 0 and following[p].get(w) == q:
                    following[p][w] = clone
                    p = link[p]
                link[q] = clone
        last = state
    return length, link, end


def _place(ends: list[list[int]], x: int) -> tuple[int, int]:
    """Block and place in it where ``x`` belongs: the first position above it, or the end of the last block below it."""
    k = bisect_left(ends, x, key=_first) - 1 if len(ends) > 1 else 0
    k = max(k, 0)
    return k, bisect_left(ends[k], x)


def _merge(large: list[list[int]], small: list[list[int]]) -> list[tuple[int, int]]:
    """Put ``small`` into ``large``.  Returns pairs of a position of one and its neighbour of the other, ascending."""
    met = []
    for block in small:
        for x in block:
            k, i = _place(large, x)
            if i:
                met.append((large[k][i - 1], x))
            if i < len(large[k]):
                met.append((x, large[k][i]))
            elif k + 1 < len(large):
                met.append((x, large[k + 1][0]))
    for block in small:
        for x in block:
            k, i = _place(large, x)
            large[k].insert(i, x)
            if len(large[k]) > BLOCK:
                large.insert(k + 1, large[k][BLOCK // 2 :])
                del large[k][BLOCK // 2 :]
    return met


def _count(ends: list[list[int]]) -> int:
    return len(ends[0]) if len(ends) == 1 else len(ends) * BLOCK // 2


def runs_of(words: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Start, length and period of each wanted run, by start and period."""
    length, link, end = automaton(words)
    held: list = [[[e]] if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for state in np.argsort(-np.asarray(length), kind="stable")[:-1].tolist():
        up = link[state]
        own, held[state] = held[state], None
        if up == 0:
            continue
        reach, other = length[up], held[up]
        if other is None:
            held[up] = own
            continue
        if _count(own) > _count(other):
            own, other = other, own
            held[up] = other
        for a, b in _merge(other, own):
            q = b - a
            if q <= reach and reach + q >= min_length and reach + q >= min_exponent * q and (b + 1 == n or words[a + 1] != words[b + 1]):
                key = (b - reach - q + 1, reach + q)
                if q < found.get(key, n):
                    found[key] = q
    return sorted((start, size, q) for (start, size), q in found.items())


def _runs(min_length: int, min_exponent: int):
    g = window_of(min_length, min_exponent)

    def of(text: bytes) -> tuple[list[tuple[int, int, int]], bytes]:
        words = text.split()  # at space and 09-0D
        if len(words) < min_length:
            return [], b" ".join(words)
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        found: list[tuple[int, int, int]] = []
        if len(numbers) < len(words):
            with np.errstate(over="ignore"):
                for lo, hi in stretches(np.asarray(ids, np.int64), g, min_length):
                    for start, size, q in runs_of(ids[lo:hi], min_length, min_exponent):
                        found.append((lo + start, size, q))
        if not found:
            return found, b" ".join(words)
        found.sort(key=lambda r: (r[0], r[2]))
        step = np.zeros(len(words) + 1, np.int64)
        for start, size, q in found:
            step[start + q] += 1
            step[start + size] -= 1
        keep = (np.cumsum(step[:-1]) == 0).tolist()
        return found, b" ".join(w for w, k in zip(words, keep) if k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def out(ids, rows):
            runs = [[dict(zip(("start", "length", "period"), r)) for r in found] for found, _ in rows]
            return pa.RecordBatch.from_arrays([ids, pa.array(runs, kind), pa.array([t for _, t in rows], pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

        for batch in batches:
            rows, size, at = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                rows.append(of(text.as_buffer().to_pybytes() if text.is_valid else b""))
                size += len(rows[-1][1])
                if size > BATCH:
                    yield out(batch.column(0).slice(at, len(rows)), rows)
                    rows, size, at = [], 0, i + 1
            if rows:
                yield out(batch.column(0).slice(at, len(rows)), rows)

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``runs`` (by start and period; numbers of words, from 0) and ``collapsed``, the
    text without the words that a run contains after its first period, joined by single spaces."""
    if min_exponent < 2:
        raise ValueError("runs have at least two periods")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_runs(min_length, min_exponent), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which every tenth document, by the crc32 of its id, repeats a stretch of its words to the end."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    tenth = (h % 10 == 0) & text.rlike(WORD)
    # A one-element array gives the words a name, so that they are cut out once.
    return F.when(tenth, F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs from all pairs of equal words at most a fourth of the text apart, as islands of one distance.
OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_reduce(list_transform(range(1, 2 * strlen(doc_id::VARCHAR), 2), lambda i: ('0x' || substr(hex(doc_id::VARCHAR), i, 2))::UBIGINT),
      lambda crc, b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, b)), 4294967295::UBIGINT) AS c
  FROM documents
), h AS (
  SELECT doc_id, w, len(w) AS n, xor(c, 4294967295)::BIGINT AS h FROM w
), a AS (
  SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS r FROM h
), p AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + r)) END]) ELSE w END AS w FROM a
), u AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM p
), m AS (
  SELECT s.doc_id, t.i - s.i AS q, s.i FROM u s JOIN u t ON t.doc_id = s.doc_id AND t.x = s.x AND t.i > s.i WHERE 4 * (t.i - s.i) <= s.n
), g AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m
), f AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM f GROUP BY doc_id, start, length
), b AS (
  SELECT doc_id, count(*) AS n_runs, max(length) AS length, min(struct_pack(l := -length, s := start, p := period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM r GROUP BY doc_id
), d AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), k AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN d USING (doc_id, i) GROUP BY doc_id
)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, b.length, best.p AS period, 1000 * b.length // best.p AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""
