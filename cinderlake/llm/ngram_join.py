"""Self-join of documents on the Jaccard similarity of their 5-word shingle sets.

Rare-first prefix filtering.  Every set is put in one global order, rarest
shingle first.  Two sets of a and b shingles that meet the threshold t share at
least ``alpha = ceil(t / (1 + t) * (a + b))`` of them, so they share one among
the first ``n - ceil(t * n) + 1`` of each, and the first one that they share lies
early enough in both to leave ``alpha`` (the positional filter, which includes
the length filter).  Candidates pass two suffix filters, which bound the overlap by
splitting both sets: around fixed pivots, from counts of n / 4 to n / 2 bytes that
are shuffled instead of the sets, then around common pivots.  The rest are verified
once, on whole sets.

The steps as Spark jobs:

1. One pass over the texts gives each document's set size and class (documents of
   one set are one class, whatever the number of copies) and counts shingles in
   2 ** 20 hashed counters, summed over all documents.  The counters are 4 MB at
   any corpus size; any consistent order keeps the filter exact, the counts only
   make it rare-first.
2. A second pass emits the prefixes, once per class and task.  They are shuffled
   by shingle, and sorted by shingle, length class and place within partitions.
3. Lists are read as sorted streams, in constant memory.  Each row is paired with
   the first row of its list in the same length class (sets within a ratio of t)
   and with its predecessor: two pairs a row, however long the list.  First is the
   set in whose order the shingle comes earliest.  In a group of near copies that
   is the text that the others were made from, which has the fewest rare shingles.
4. Of these, each class keeps the pair that the most lists share, so at most one
   pair a class is verified, and the links are joined to components.
5. Lists that still hold several components are open.  While all pairs of their
   components would be many more than a few pairs a row, a round deals each open
   list in a seeded order, pairs every row with the next rows of other components
   (4, then 32, then twice as many each round), verifies these pairs once and contracts what they
   link.  Pairs within a component add no reachability, so they are never made: a
   group of near copies costs its size a round, not its square, even where the text
   that they were made from is absent.
6. What is open after that is joined exactly: all pairs of different components
   that pass the filters, one side without the list's largest component, and without
   pairs that were verified before.

No link between components is lost: both ends of a link share a prefix shingle,
and either a round joined their components or step 6 verifies the pair.  The rounds
end when they would cost as much as step 6, so they never change the result.

Shingles that occur far more often than the average counter are dealt over salts in
step 3, so no task reads such a list alone; all its rows take part in steps 5 and 6.

Defined results: null, empty and blank texts have no shingles, link with nothing
and are components of their own; a text of 1 to 4 words has one shingle, its
whole word sequence; ties and repeated rows are copies of one class; null ids are
kept; an empty table gives an empty result; extra columns are ignored.  Sets are
held as 64-bit hashes of shingles (48 bits where they are verified), classes as
64-bit fingerprints of sets.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hint_for, staged, table, tasks_for
from .graph import components
from .shingles import fingerprint, shingle_sets

COUNTERS = 1 << 20
COUNTER_BLOCKS = 64
#: Places for classes that a task has met lately, so as to emit most of them once.
SEEN = 1 << 18
#: Rows of a hot list that one task reads, about.
LIST_ROWS = 1 << 16
#: Rows of an open list that a round deals to one task, about, or more where it pairs each with many.
PART_ROWS = 1 << 10
#: Rows that the first round pairs each row of an open list with, and those of the second round, which later ones double.
WIDTH, WIDE = 4, 32
FIRST = ["doc_id", "n", "cls", "sketch", "block", "counts"]


def alpha(a, b, num: int, den: int):
    """Least overlap at which two sets of a and b elements have Jaccard >= num / den."""
    return (num * (a + b) + num + den - 1) // (num + den)


def prefix_length(n, num: int, den: int):
    return n - (num * n + den - 1) // den + 1


LEVEL, PLACE = 56, 32
#: Length classes fit 7 bits for sizes up to 2 ** 32.
LEAST_STEP = 32 * math.log(2) / 126


def packed(n: int, places: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length class, place in the set's order, and size of the set, in the order that lists are sorted by.

    Sets of one length class are within a ratio of num / den, or 0.84 if that is
    less.  Places stop at 2 ** 24 - 1, which makes the positional filter pass more,
    never less.
    """
    level = int(math.log(n) / max(LEAST_STEP, math.log(den / num)) + 1e-9)
    return (level << LEVEL) + (np.minimum(places, (1 << 24) - 1) << PLACE) + n


def sketch(s: np.ndarray) -> bytes:
    """How many elements lie in each of 2 ** floor(log2(n)) equal ranges of hashes, two counts a byte; empty if a count passes 15."""
    bits = max(1, len(s).bit_length() - 1)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    if counts.max() > 15:
        return b""
    counts = counts.astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def may_link(p: bytes, q: bytes, num: int, den: int) -> bool:
    """The suffix filter at fixed pivots: whether the sums of smaller counts leave enough overlap.  An empty sketch passes."""
    if not len(p) or not len(q):
        return True
    p, q = (np.stack((x & 15, x >> 4), 1).reshape(-1) for x in (np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)))
    least = alpha(int(p.sum()), int(q.sum()), num, den)
    if len(p) > len(q):
        p = p.reshape(len(q), -1).sum(1)
    elif len(q) > len(p):
        q = q.reshape(len(p), -1).sum(1)
    return int(np.minimum(p, q).sum()) >= least


def _met() -> Callable[[int], bool]:
    """Tells whether a class was met lately.  Of two classes that share a place the later one stays; one met again is emitted again, which costs little."""
    last = array("q", [1]) + array("q", bytes(8 * SEEN - 8))  # no class is at its own place yet

    def met(c: int) -> bool:
        at = c & (SEEN - 1)
        again = last[at] == c
        last[at] = c
        return again

    return met


def _counted(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = np.zeros(COUNTERS, np.int64), _met()
        for batch in batches:
            sizes, classes, sketches, fresh, held = [], [], [], [], 0
            for s in shingle_sets(batch.column(1), k):
                c = fingerprint(s) if len(s) else 0
                sizes.append(len(s))
                classes.append(c)
                sketches.append(sketch(s) if len(s) else None)
                if len(s) and not met(c):
                    fresh.append((s >> np.uint64(44)).astype(np.int32))
                    held += len(s)
                    if held > 1 << 20:
                        counts += np.bincount(np.concatenate(fresh), minlength=COUNTERS)
                        fresh, held = [], 0
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=COUNTERS)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                FIRST,
            )
        if counts.any():
            m = COUNTER_BLOCKS
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.binary()), *_blocks(counts)], FIRST)

    return run


def _blocks(counts: np.ndarray) -> list[pa.Array]:
    """Counters by block, compressed: those of a few texts are mostly zero."""
    parts = counts.astype("<u4").reshape(COUNTER_BLOCKS, -1)
    return [pa.array(range(COUNTER_BLOCKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())]


def _chosen_sets(batch: pa.RecordBatch, k: int, wanted) -> Iterator[np.ndarray]:
    """The sets of a batch (``doc_id, text``); ``wanted``: only of documents whose id, or class where they have none, is on a bitmap."""
    if wanted is None:
        yield from shingle_sets(batch.column(1), k)
        return
    bitmaps, width = wanted
    known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    (on,) = _on_bitmaps(bitmaps, width, batch.column(0).fill_null(0).to_numpy())
    at = np.flatnonzero(on | ~known)
    for i, s in zip(at, shingle_sets(batch.column(1).take(pa.array(at)), k)):
        if known[i] or len(s) and _on_bitmaps(bitmaps, width, np.asarray([fingerprint(s)], np.int64))[0][0]:
            yield s


def _chosen_counts(k: int, wanted):
    """Counters of the shingles of wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = np.zeros(COUNTERS, np.int64), _met()
        for batch in batches:
            for s in _chosen_sets(batch, k, wanted):
                if len(s) and not met(fingerprint(s)):
                    np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
        if counts.any():
            yield pa.RecordBatch.from_arrays(_blocks(counts), ["block", "counts"])

    return run


def _sum_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS // COUNTER_BLOCKS, np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), "<u4")
    total = np.minimum(total, 2**32 - 1).astype("<u4")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])


def _prefixes(k: int, num: int, den: int, counts, usual: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, met = np.frombuffer(counts.value, "<u4"), _met()

        def out(parts):
            h, f, c, z = (np.concatenate(x) for x in zip(*parts))
            # Above the usual count, LIST_ROWS rows a salt; the list's number of salts hangs on its counter alone.
            salts = np.maximum(f.astype(np.int64) - usual, 0) // LIST_ROWS
            salt = np.where(salts > 0, (c >> 18) % (salts + 1) + 1, 0).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(c), pa.array(z)], ["h", "salt", "cls", "np"])

        for batch in batches:
            parts, held = [], 0
            for s in _chosen_sets(batch, k, wanted):
                if not len(s):
                    continue
                c, n = fingerprint(s), len(s)
                if met(c):
                    continue
                p = prefix_length(n, num, den)
                f = freq[(s >> np.uint64(44)).astype(np.int64)]
                first = np.argsort(f, kind="stable")[:p]  # s is sorted: ties go by hash
                parts.append((s[first], f[first], np.full(p, c, np.int64), packed(n, np.arange(p, dtype=np.int64), num, den)))
                held += p
                if held > 100_000:
                    yield out(parts)
                    parts, held = [], 0
            if parts:
                yield out(parts)

    return run


def _passes(z1: np.ndarray, z2: np.ndarray, num: int, den: int) -> np.ndarray:
    """The positional filter, for a shingle at these places of these sets."""
    n1, n2 = z1 & 0xFFFFFFFF, z2 & 0xFFFFFFFF
    a = alpha(n1, n2, num, den)
    return (n1 - (z1 >> PLACE & 0xFFFFFF) >= a) & (n2 - (z2 >> PLACE & 0xFFFFFF) >= a)


def _lists(num: int, den: int):
    """Sorted lists to pairs (kind 0: x, y classes, z how often) and rows of lists of several classes (kind 1: x shingle, y class, z size and place)."""

    def batch_of(kind, x, y, z):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(z)], ["kind", "x", "y", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row held back: h, salt, c, z, whether it continues a list, its pivot's c and z
        for batch in batches:
            if not batch.num_rows:
                continue
            h, salt, c, z = (batch.column(i).to_numpy() for i in range(4))
            went_on, pc0, pz0 = False, 0, 0
            if last is not None:
                h, salt, c, z = (np.concatenate((np.asarray([v], x.dtype), x)) for v, x in zip(last[:4], (h, salt, c, z)))
                went_on, pc0, pz0 = last[4:]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            h, salt, c, z = h[fresh], salt[fresh], c[fresh], z[fresh]
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])
            level = z >> LEVEL
            start = ~same
            start[1:] |= level[1:] != level[:-1]
            at = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
            pc, pz = c[at], z[at]
            if last is not None:
                pc[at == 0], pz[at == 0] = pc0, pz0
            same[0] = went_on
            # Pairs of each new row with its pivot and with the row before it.
            i = np.arange(1, len(h))
            star = i[same[1:] & (pc[1:] != c[1:])]
            chain = i[same[1:] & (c[:-1] != pc[1:])]
            x = np.concatenate((pc[star], c[chain - 1]))
            y = np.concatenate((c[star], c[chain]))
            zx, zy = np.concatenate((pz[star], z[chain - 1])), np.concatenate((z[star], z[chain]))
            ok = _passes(zx, zy, num, den) & (x != y)
            if ok.any():
                x, y = x[ok], y[ok]
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                at = np.flatnonzero(new)
                yield batch_of(0, x[at], y[at], np.diff(np.append(at, len(x))))
            several = same | (salt > 0)
            several[:-1] |= same[1:]
            several[-1] = False
            if several.any():
                yield batch_of(1, h[several], c[several], z[several])
            last = (h[-1], salt[-1], c[-1], z[-1], bool(same[-1]), pc[-1], pz[-1])
        if last is not None and (last[4] or last[1]):
            yield batch_of(1, *(np.asarray([v], np.int64) for v in (last[0], last[2], last[3])))

    return run


def _next_rows(width: int, num: int, den: int):
    """Open lists in their order (h, salt, c, comp, z) to pairs of each row with the next ``width`` rows of its part, where components differ and the filters pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(5)]
            old = 0
            if held is not None:
                old = len(held[0])
                cols = [np.concatenate(x) for x in zip(held, cols)]
            h, salt, c, comp, z = cols
            found = []
            for step in range(1, min(width, len(h) - 1) + 1):
                i = np.arange(max(0, old - step), len(h) - step)
                j = i + step
                ok = (h[i] == h[j]) & (salt[i] == salt[j]) & (comp[i] != comp[j])
                i, j = i[ok], j[ok]
                ok = _passes(z[i], z[j], num, den)
                found.append(np.stack((np.minimum(c[i], c[j])[ok], np.maximum(c[i], c[j])[ok])))
            pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
            if pairs.size:
                a, b = np.unique(pairs, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held = [x[-width:] for x in cols]

    return run


def _hamming(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """A lower bound of the Hamming distance of two sorted sets."""
    if not depth or not len(a) or not len(b):
        return abs(len(a) - len(b))
    mid = b[len(b) // 2]
    i = int(np.searchsorted(a, mid))
    hit = i < len(a) and a[i] == mid
    j = len(b) // 2
    return _hamming(a[:i], b[:j], depth - 1) + _hamming(a[i + hit :], b[j + 1 :], depth - 1) + (not hit)


#: Columns of pairs: two classes and the documents that stand for them.
PAIR = ["a", "b", "key_a", "key_b"]
#: Sets are shipped as the upper 48 bits of each hash.
SHIPPED = 6


def shipped(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SHIPPED :]).tobytes()


def received(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SHIPPED, 8), np.uint8)
    out[:, :SHIPPED] = np.frombuffer(data, np.uint8).reshape(-1, SHIPPED)
    return out.view("<u8").reshape(-1)


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = received(p.as_buffer()), received(q.as_buffer())
                least = alpha(len(p), len(q), num, den)
                if min(len(p), len(q)) < least or _hamming(p, q, 3) > len(p) + len(q) - 2 * least:
                    continue
                both = np.concatenate((p, q))
                both.sort()
                keep[i] = np.count_nonzero(both[1:] == both[:-1]) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _on_bitmaps(bitmaps, width: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys either bitmap holds."""
    at = keys & (width - 1)
    return tuple((np.frombuffer(x, np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool) for x in bitmaps.value)


def _wanted_sketches(bitmaps, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            as_a, as_b = _on_bitmaps(bitmaps, width, batch.column(0).to_numpy())
            keep = pa.array(as_a | as_b)
            columns = [batch.column(1), pa.array(as_a), pa.array(as_b), batch.column(2)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["cls", "as_a", "as_b", "sketch"])

    return run


def _wanted_sets(k: int, bitmaps, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["cls", "as_a", "as_b", "set"])

        for batch in batches:
            rows, held = [], 0
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            sides = [x | ~known for x in _on_bitmaps(bitmaps, width, batch.column(0).fill_null(0).to_numpy())]
            at = np.flatnonzero(sides[0] | sides[1])
            for i, s in zip(at, shingle_sets(batch.column(1).take(pa.array(at)), k)):
                if not len(s):
                    continue
                c, as_a, as_b = fingerprint(s), bool(sides[0][i]), bool(sides[1][i])
                if not known[i]:  # a row without an id goes by its class
                    as_a, as_b = (bool(x[0]) for x in _on_bitmaps(bitmaps, width, np.asarray([c], np.int64)))
                    if not (as_a or as_b):
                        continue
                rows.append((c, as_a, as_b, shipped(s)))
                held += len(s)
                if held > 1 << 19:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return run


def _near(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([may_link(p.as_buffer(), q.as_buffer(), num, den) for p, q in zip(batch.column("sketch_a"), batch.column("sketch_b"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in PAIR], PAIR)

    return run


def _bitmap(keys: DataFrame, width: int) -> bytes:
    """Bits of the keys' low parts."""
    bit = F.col("key").bitwiseAND(F.lit(width - 1)) + 1  # Spark's buckets count from 1, and hold 32,768 positions
    parts = keys.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    out = np.zeros(width // 8, np.uint8)
    for r in parts.coalesce(8).toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["bucket"] - 1) * 4096 :][: len(part)] = part
    return out.tobytes()


def _bitmaps(pairs: DataFrame):
    """A bitmap of the documents that stand for classes, for either side of the pairs: at most 64 MB each, and 32 bits a pair below that."""
    width = 1 << min(29, max(16, (32 * pairs.count()).bit_length()))
    return pairs.sparkSession.sparkContext.broadcast(tuple(_bitmap(pairs.select(F.col(c).alias("key")), width) for c in ("key_a", "key_b"))), width


def bitmap_of(keys: DataFrame):
    """A broadcast bitmap of ``key``, as ``_bitmaps`` makes them."""
    width = 1 << min(29, max(16, (32 * keys.count()).bit_length()))
    return keys.sparkSession.sparkContext.broadcast((_bitmap(keys, width),)), width


def _with_both(pairs: DataFrame, sides: DataFrame, what: str) -> DataFrame:
    for x in "ab":
        pairs = pairs.join(sides.where(f"as_{x}").select(F.col("cls").alias(x), F.col(what).alias(f"{what}_{x}")), x)
    return pairs


def verify(rows: DataFrame, first: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int, tag: str) -> DataFrame:
    """The links among ``pairs`` (``a, b``: classes).

    Sketches are compared first, then sets, which are made anew for one document of
    each class in a pair that is left (``classes``: ``cls, key``).  Bitmaps of these
    documents keep most other sketches and sets from being shuffled; they pass every
    document that is wanted, so the joins after them stay exact.
    """
    hinted = hint_for(pairs)
    pairs = hinted(pairs).join(classes.select(F.col("cls").alias("a"), F.col("key").alias("key_a")), "a")
    pairs = staged(hinted(pairs).join(classes.select(F.col("cls").alias("b"), F.col("key").alias("key_b")), "b").select(*PAIR), f"{tag}-keyed")
    bitmaps, width = _bitmaps(pairs)
    held = first.where("sketch is not null").select(F.coalesce("doc_id", "cls").alias("key"), "cls", "sketch")
    sketches = staged(held.mapInArrow(_wanted_sketches(bitmaps, width), "cls long, as_a boolean, as_b boolean, sketch binary"), f"{tag}-sketches")
    both = _with_both(hinted(pairs), sketches, "sketch").select(*PAIR, "sketch_a", "sketch_b")
    near = staged(both.mapInArrow(_near(num, den), "a long, b long, key_a long, key_b long").distinct(), f"{tag}-near")
    bitmaps, width = _bitmaps(near)
    sets = staged(rows.mapInArrow(_wanted_sets(k, bitmaps, width), "cls long, as_a boolean, as_b boolean, set binary"), f"{tag}-sets")
    both = _with_both(hint_for(near)(near), sets, "set").select("a", "b", "set_a", "set_b")
    return staged(both.mapInArrow(_verified(num, den), "a long, b long"), f"{tag}-links")


def _contracted(comp: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """``comp`` (``node, comp``) after components that ``links`` (``a, b``: nodes) connect are joined.  Nodes without a row are components of their own."""
    if links.isEmpty():
        return comp
    ends = links
    for x in "ab":
        ends = ends.join(comp.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")), x, "left")
    ends = staged(ends.select("a", "b", F.coalesce("comp_a", "a").alias("top_a"), F.coalesce("comp_b", "b").alias("top_b")), f"{tag}-ends")
    tops = components(ends.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")), tag).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    lone = ends.select(F.col("a").alias("node"), F.col("top_a").alias("comp")).unionByName(ends.select(F.col("b").alias("node"), F.col("top_b").alias("comp")))
    nodes = comp.unionByName(lone.where("node = comp").distinct().join(comp.select("node"), "node", "left_anti"))
    return staged(nodes.join(tops, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), f"{tag}-joined")


def _open_lists(posts: DataFrame, comp: DataFrame, tag: str) -> tuple[DataFrame, int, int]:
    """Rows of lists in which several components meet (with ``comp``, and ``rows`` and ``largest`` of the list), their number, and the number of their pairs of different components."""
    posts = posts.join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    posts = staged(posts, f"{tag}-posts")
    sizes = posts.groupBy("h", "comp").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("h").agg(
        F.count("*").alias("comps"), F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.max_by("comp", F.struct("n", "comp")).alias("largest")
    )
    lists = staged(lists.where("comps > 1"), f"{tag}-mixed")
    total = lists.agg(F.sum("rows").alias("rows"), F.sum((F.col("rows").cast("double") * F.col("rows") - F.col("squares")) / 2).alias("pairs")).first()
    if not total["rows"]:
        return posts.limit(0), 0, 0
    return staged(posts.join(lists.select("h", "rows", "largest"), "h"), f"{tag}-open"), total["rows"], int(total["pairs"])


def _round(posts: DataFrame, seed: int, width: int, num: int, den: int) -> DataFrame:
    """Pairs of each row of open lists with the next rows of other components, in an order by length class and seeded hash."""
    part = max(PART_ROWS, 16 * width)
    salt = F.pmod(F.xxhash64(F.lit(2 * seed), "cls"), F.ceil(F.col("rows") / part)).cast("int")
    dealt = posts.select("h", salt.alias("salt"), "cls", "comp", "np", F.shiftright("np", LEVEL).alias("level"), F.xxhash64(F.lit(2 * seed + 1), "cls").alias("place"))
    dealt = dealt.repartition(tasks_for(dealt), "h", "salt").sortWithinPartitions("h", "salt", "level", "place").select("h", "salt", "cls", "comp", "np")
    return dealt.mapInArrow(_next_rows(width, num, den), "a long, b long").distinct()


#: Words of parities of a set.
PARITIES = 4


def parity(s: np.ndarray) -> list[int]:
    """Of a set, 256 bits as four signed integers: whether it has an odd number of elements in each of 256 classes of hashes.

    Bits in which two sets differ are at most as many as the elements that only one of them has.
    """
    odd = np.bincount((s >> np.uint64(7) & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _all_pairs(posts: DataFrame, num: int, den: int, parities: DataFrame | None = None) -> DataFrame:
    """All pairs of rows of different components of a list that pass the filters; one side leaves out the list's largest component.

    ``parities``: ``cls, bits``, for a filter on how many elements only one set has.
    """
    alike = F.lit(True)
    if parities is not None:
        posts = staged(posts.join(parities, "cls"), "join-parities")
        both = (F.col("z1").bitwiseAND(F.lit(0xFFFFFFFF)) + F.col("z2").bitwiseAND(F.lit(0xFFFFFFFF))) * (den - num)
        differ = [F.bit_count(F.col("bits1")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(PARITIES)]
        alike = sum(differ[1:], differ[0]) * (num + den) <= both
    bits = ["bits"] if parities is not None else []
    left = posts.where("comp <> largest").select("h", F.col("cls").alias("c1"), F.col("comp").alias("k1"), F.col("np").alias("z1"), *[F.col(b).alias("bits1") for b in bits])
    right = posts.select("h", F.col("cls").alias("c2"), F.col("comp").alias("k2"), F.col("np").alias("z2"), *[F.col(b).alias("bits2") for b in bits])
    n1, n2 = (F.col(z).bitwiseAND(F.lit(0xFFFFFFFF)) for z in ("z1", "z2"))
    place1, place2 = (F.shiftright(z, PLACE).bitwiseAND(F.lit(0xFFFFFF)) for z in ("z1", "z2"))
    least = F.floor((num * (n1 + n2) + (num + den - 1)) / F.lit(num + den)).cast("long")
    fits = (n1 - place1 >= least) & (n2 - place2 >= least)
    met = left.join(right, (left.h == right.h) & (F.col("k1") != F.col("k2")) & fits & alike)
    return met.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct()


def prefix_lists(rows: DataFrame, blocks: DataFrame, k: int, num: int, den: int, tag: str, wanted=None) -> tuple[DataFrame, DataFrame]:
    """Lists of the classes that share a shingle among their rarest, as posts for ``settle``, and first pairs (``a, b``): a class's pair with a smaller one that the most lists share.

    ``blocks``: ``block, counts``, the counters by task.  ``wanted``: a bitmap of the documents that take part.
    """
    counts = np.zeros((COUNTER_BLOCKS, COUNTERS // COUNTER_BLOCKS), "<u4")
    for r in blocks.groupBy("block").applyInArrow(_sum_counts, "block int, counts binary").collect():
        counts[r["block"]] = np.frombuffer(r["counts"], "<u4")
    shared = rows.sparkSession.sparkContext.broadcast(counts.tobytes())
    prefixes = rows.mapInArrow(_prefixes(k, num, den, shared, 2 * int(counts.mean()), wanted), "h long, salt int, cls long, np long")
    by_shingle = prefixes.repartition(tasks_for(prefixes), "h", "salt").sortWithinPartitions("h", "salt", "np", "cls")
    lists = staged(by_shingle.mapInArrow(_lists(num, den), "kind int, x long, y long, z long"), f"{tag}-lists")
    shared_by = lists.where("kind = 0").groupBy("x", "y").agg(F.sum("z").alias("n"))
    pairs = staged(shared_by.groupBy(F.col("y").alias("b")).agg(F.max_by("x", F.struct("n", "x")).alias("a")).select("a", "b"), f"{tag}-pairs")
    return lists.where("kind = 1").select(F.col("x").alias("h"), F.col("y").alias("cls"), F.col("z").alias("np")), pairs


def settle(
    rows: DataFrame, first: DataFrame, classes: DataFrame, posts: DataFrame, pairs: DataFrame, k: int, num: int, den: int, tag: str, joined: tuple[DataFrame, DataFrame] | None = None, width: int = WIDTH, parities: DataFrame | None = None
) -> DataFrame:
    """Components (``node, comp``: classes) of all links between classes that share a list.

    ``posts``: rows of lists (``h, cls, np``: list, class, size and place).  ``pairs`` (``a, b``) are verified
    first; then come rounds over the lists that are still open, and the exact join.  ``joined``: components
    and verified pairs that are there already.  ``width``: rows that the first round pairs each row with.
    ``parities``: ``cls, bits``, one more filter for the exact join.
    """
    if joined is None:
        comp = components(verify(rows, first, classes, pairs, k, num, den, f"{tag}-0"), f"{tag}-comp")
        done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    else:
        comp, done = joined
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(done, ["a", "b"], "left_anti")
        for x in "ab":  # pairs within a component add nothing
            pairs = pairs.join(comp.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")), x, "left")
        pairs = staged(pairs.where(~F.col("comp_a").eqNullSafe(F.col("comp_b")) | F.col("comp_a").isNull()).select("a", "b"), f"{tag}-fresh")
        comp = _contracted(comp, verify(rows, first, classes, pairs, k, num, den, f"{tag}-0"), f"{tag}-comp")
        done = done.unionByName(pairs)
    number, last = 0, False
    while not last:
        number += 1
        step = f"{tag}-{number}"
        open_posts, n_rows, n_pairs = _open_lists(posts, comp, step)
        if not n_rows:
            break
        last = n_pairs <= 4 * width * n_rows
        more = _all_pairs(open_posts, num, den, parities) if last else _round(open_posts, number, width, num, den)
        more = staged(more.join(done, ["a", "b"], "left_anti"), f"{step}-more")
        if not more.isEmpty():
            comp = _contracted(comp, verify(rows, first, classes, more, k, num, den, step), f"{step}-comp")
            done = done.unionByName(more)
        posts, width = open_posts.select("h", "cls", "np"), max(WIDE, 2 * width)
    return comp


def classes_of(members: DataFrame, tag: str) -> DataFrame:
    """``members``: ``doc_id, n, cls`` (null without shingles).  A row for each class: its least id, the document that stands for it, its rows."""
    classes = members.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min(F.coalesce("doc_id", "cls")).alias("key"), F.count("*").alias("n")
    )
    return staged(classes, f"{tag}-classes")


def by_document(members: DataFrame, classes: DataFrame, comp: DataFrame, tag: str) -> DataFrame:
    """Back to the documents: only classes of several documents or of a component need a row."""
    classes = classes.join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left").where("n > 1 or comp is not null")
    classes = staged(classes.withColumn("comp", F.coalesce("comp", "cls")), f"{tag}-grouped")
    heads = staged(classes.groupBy("comp").agg(F.min("least").alias("component_id")), f"{tag}-heads")
    named = staged(classes.join(heads, "comp").select("cls", "component_id"), f"{tag}-named")
    return members.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    g = math.gcd(percent, 100)
    num, den = percent // g, 100 // g
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = staged(rows.mapInArrow(_counted(k), "doc_id long, n long, cls long, sketch binary, block int, counts binary"), "join-first")
    members = first.where("block is null").select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    classes = classes_of(members, "join")
    posts, pairs = prefix_lists(rows.select(F.lit(None).cast("long").alias("doc_id"), "text"), first.where("block is not null").select("block", "counts"), k, num, den, "join")
    return by_document(members, classes, settle(rows, first, classes, posts, pairs, k, num, den, "join"), "join")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
  FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * c >= 75 * (p.n + q.n - c)
), r AS (
  SELECT a AS doc, a AS reach FROM e UNION SELECT r.doc, e.b FROM r JOIN e ON e.a = r.reach
), m AS (SELECT doc, min(reach) AS c FROM r GROUP BY doc)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.c, n.doc_id) AS component_id FROM n LEFT JOIN m ON m.doc = n.doc_id
"""
