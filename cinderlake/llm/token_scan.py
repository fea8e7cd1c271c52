"""Token counts from flat token files by a separator scan.

A flat token file holds the ids of many documents one after another, each ended
by an end-of-document id, without an index.  The scan reads files in blocks of
``block_bytes``, anywhere in the cluster, and finds the separators of a block with
one vectorised comparison.  A prefix scan over the blocks of a file (running
counts, running last separator) stitches documents that cross block boundaries,
whatever number of blocks they span.

Files are read and written through pyarrow's file systems, in the shared folder
of the cluster.  A writing task writes under a temporary name and renames; the
staged manifest names the files that count.

Defined results: a null text has no ids but its separator (1 token); ids after
the last separator of a file are one more document, marked unended; an empty
file has no documents; an empty table gives an empty result; repeated rows are
documents of their own; extra columns are ignored, whatever their names; a text of any
length is written whole, by one task, which holds its ids, and is scanned in blocks.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, staged, table, tasks_for
from .tokens import default_path

BLOCK_BYTES = 1 << 20
FILE_BYTES = 1 << 26
SEPARATOR = 50256
KIND = np.dtype("<u2")
_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _write(folder: str, path: str, separator: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        out = temporary = None
        docs: list = []
        size = 0

        def close():
            nonlocal out, number, docs, size
            out.close()
            name = f"{root}/tokens-{part:06d}-{number:04d}.u16"
            fs.move(temporary, name)
            rows = pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"] * len(docs)), pa.array([size] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.int64())],
                ["file", "bytes", "ordinal", "doc_id"],
            )
            out, number, docs, size = None, number + 1, [], 0
            return rows

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    temporary = f"{root}/.tmp-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                ids = encoding.encode_ordinary(text.as_py()) if text.is_valid else []
                ids.append(separator)
                data = np.asarray(ids, KIND).tobytes()
                out.write(data)
                size += len(data)
                docs.append(doc)
                if size >= file_bytes:
                    yield close()
        if out is not None:
            yield close()

    return run


def write_flat(docs: DataFrame, folder: str, tokenizer: str | None = None, separator: int = SEPARATOR, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` as flat token files.  Returns the staged order of writing: ``file, bytes, ordinal, doc_id``."""
    path = tokenizer or default_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return staged(rows.mapInArrow(_write(folder, path, separator, file_bytes), "file string, bytes long, ordinal long, doc_id long"), "flat-order")


def _scan(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["file"])
                with fs.open_input_file(path) as f:
                    f.seek(row["first"])
                    ids = np.frombuffer(f.read(row["size"]), KIND)
                found = np.flatnonzero(ids == separator) + row["first"] // KIND.itemsize
                last = int(found[-1]) if len(found) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["bytes"]], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([last], pa.int64()), pa.array([found.astype("<i8").tobytes()], pa.binary())],
                    ["file", "bytes", "block", "n", "last", "found"],
                )

    return run


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.frombuffer(row["found"], "<i8")
            starts = np.concatenate(([row["previous"]], ends[:-1])) + 1 if len(ends) else ends
            ended = np.ones(len(ends), bool)
            rest = row["bytes"] // KIND.itemsize
            after = int(ends[-1]) if len(ends) else row["previous"]
            if row["final"] and after + 1 < rest:
                starts, ends, ended = np.append(starts, after + 1), np.append(ends, rest - 1), np.append(ended, False)
            m = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["file"]] * m, pa.string()), pa.array(row["before"] + np.arange(m, dtype=np.int64)), pa.array(starts.astype(np.int64)), pa.array((ends - starts + 1).astype(np.int64)), pa.array(ended)],
                ["file", "ordinal", "start", "n_tokens", "ended"],
            )


def separator_scan(files: DataFrame, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``files``: ``file, bytes``.  One row per document: ``file, ordinal, start, n_tokens, ended``."""
    step = block_bytes // KIND.itemsize * KIND.itemsize
    blocks = (
        files.where("bytes > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step).cast("long"))))
        .withColumn("first", F.col("block") * step)
        .withColumn("size", F.least(F.lit(step), F.col("bytes") - F.col("first")))
    )
    blocks = blocks.repartition(tasks_for(files), "file", "block")
    scanned = staged(blocks.mapInArrow(_scan(separator), "file string, bytes long, block long, n long, last long, found binary"), "flat-blocks")
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # The prefix scan carries counts only; the separators' places are joined to it by block.
    places = scanned.select("file", "block", "n", "last")
    placed = (
        places.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("previous", F.coalesce(F.max("last").over(earlier), F.lit(-1)).cast("long"))
        .withColumn("final", F.lead("block").over(order).isNull())
        .select("file", "block", "before", "previous", "final")
        .join(scanned.select("file", "block", "bytes", "found"), ["file", "block"])
    )
    return placed.mapInArrow(_stitched, "file string, ordinal long, start long, n_tokens long, ended boolean")


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = write_flat(docs, new_path(spark, "flat"))
    files = order.groupBy("file").agg(F.max("bytes").alias("bytes"))
    found = separator_scan(files)
    return order.join(found, ["file", "ordinal"], "full").select("doc_id", "n_tokens", "ended")
