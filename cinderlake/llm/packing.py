"""Best-fit-decreasing packing of token sequences.

Documents are tokenised (ids, then one separator id); those longer than a
sequence are cut into pieces of its length.  Pieces are placed longest first,
each into the open sequence with the least room that still holds it.

Best-fit decreasing looks at lengths only, and lengths are at most the capacity,
so the whole corpus is planned from the table "pieces by length" (``capacity``
rows at most).  A segment tree over remaining capacities holds the open
sequences as ranges of equal sequences; finding the tightest room takes one walk
down the tree.  Equal pieces are placed a run at a time, exactly where they would
go one by one: into one range of sequences until it or the run ends, filling each
sequence with as many as it holds.  What a range has left after that is under
half of its room, so it is used at most log2(capacity) times, and the plan has
under 40 rows a length at any corpus size.

A piece finds its place from its rank among pieces of its length, by binary
search in the plan.  Ranks come from counts by (length, salt), so a hot length is
dealt over as many sorts as its count needs, ``SALT_ROWS`` pieces each.

Defined results: null and empty texts are one piece, the separator; pieces of one
length are ranked by salt, then id, piece and content, so reruns agree; repeated
rows are packed each; an empty table gives an empty result; extra columns are
ignored.  A text of any length is tokenised whole, by one task, which holds its ids
(4 bytes each); its pieces are dealt like any others.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .tokens import SpacedTokens, default_path

CAPACITY = 2048
SEPARATOR = 0
SALT_ROWS = 1 << 14  # pieces of one length that are ranked together, about
SLICE = 256  # texts that are held as Python strings at once


class OpenBins:
    """Ranges of open bins by remaining capacity, under a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.ranges = [deque() for _ in range(capacity + 1)]

    def _mark(self, leaf: int) -> None:
        i = leaf + self.size
        self.any[i] = bool(self.ranges[leaf])
        while i > 1:
            i //= 2
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def put(self, room: int, first: int, number: int) -> None:
        if room and number:
            self.ranges[room].append((first, number))
            self._mark(room)

    def put_back(self, room: int, first: int, number: int) -> None:
        if number:
            self.ranges[room].appendleft((first, number))
            self._mark(room)

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that some bin has."""
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].popleft()
        self._mark(room)
        return out


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, number, first bin, offset, pieces a bin), by length and rank."""
    bins, plan, used = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(number: int, first: int, room: int, each: int) -> None:
            nonlocal left, rank
            plan.append((length, rank, number, first, capacity - room, each))
            bins.put(room - each * length, first, number // each)
            left, rank = left - number, rank + number

        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, number = capacity, used, -(-left // (capacity // length))
                used += number
            else:
                first, number = bins.take(room)
            each = room // length
            whole = min(number, left // each)
            if whole:
                place(whole * each, first, room, each)
            if left and whole < number:
                place(left, first + whole, room, left)
                whole += 1
            if whole < number:
                bins.put_back(room, first + whole, number - whole)
    plan.sort()
    return np.asarray(plan, np.int64).reshape(-1, 6)


def _pieces(path: str, capacity: int, separator: int):
    end = np.asarray([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = SpacedTokens.at(path)
        for batch in batches:
            docs = batch.column(0)
            rows, piece, start, length, crc = [], [], [], [], []
            for lo in range(0, batch.num_rows, SLICE):
                texts = [t or "" for t in batch.column(1).slice(lo, SLICE).to_pylist()]
                for i, ids in enumerate(map(tokens.ids, texts), lo):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _placed(plan, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            step = rank - rows[at, 1]
            each = rows[at, 5]
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(rows[at, 3] + step // each), pa.array(rows[at, 4] + step % each * length)], [*names, "sequence_id", "offset"]
            )

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` to staged ``pieces`` (``doc_id, piece, start, length, ids_crc32``)."""
    spark = pieces.sparkSession
    names = pieces.columns
    lengths = staged(pieces.groupBy("length").agg(F.count("*").alias("n")), "pack-lengths")  # ``capacity`` rows at most
    by_length = {r["length"]: r["n"] for r in lengths.collect()}
    salts = F.broadcast(lengths.select("length", F.ceil(F.col("n") / SALT_ROWS).alias("_salts")))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("_salts")).cast("int")
    rows = pieces.join(salts, "length").select(*names, salt.alias("_salt"))
    counts = staged(rows.groupBy("length", "_salt").agg(F.count("*").alias("n")), "pack-counts")
    plan = spark.sparkContext.broadcast(best_fit_plan(by_length, capacity))
    upto = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        rows.withColumn("_in", F.row_number().over(inside))
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_in") - 1)
        .select(*names, "_rank")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(_placed(plan, names), f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer``: the path of a tokenizers file that drops white space.
    """
    path = tokenizer or default_path("word_bpe_49k.json")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(path, capacity, separator), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    return pack_pieces(staged(cut, "pack-pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))
