"""A deterministic sharded WARC writer, and its reader.

Records are dealt to shards by ranges of their id and sorted within.  The cut
points are quantiles of a bounded sample (about ``SAMPLE`` ids, or ``SAMPLE_EACH`` a
shard, with the smallest hashes: those under a threshold that the number of rows
gives), so they depend on the table alone, not on partitions or cluster size.  Tables
of more than ``MOST_SHARDS`` shards have larger ones.  A
task writes a shard as a sorted stream: every record is a gzip member of its own,
and a file is closed once its compressed size reaches ``roll_bytes``.  Headers,
record ids, payload digests and lengths are made anew from the records.  A file is
written under a temporary name and renamed when it is whole; the staged manifest
lists the files that count, so a task that runs again, here or on another
executor, changes nothing.

Of records with equal payloads of at least ``least_bytes``, the one with the
smallest id carries the payload; the others are revisits that refer to it.

Defined results: a null page is the empty payload; payloads below ``least_bytes``
are all responses; rows that repeat the smallest id are responses as well; pages of
one id are each a record, by their own payload; a null id goes to the first shard, and
revisits the page with the smallest id of its payload (pages without any are responses); a
null url has no target field and comes back as null; white space and control
characters in a url are percent-encoded; repeated rows are records of their own; an
empty table gives no files; extra columns are ignored; a page of any length is one
record, held by one task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged, table

SAMPLE = 10_000
SAMPLE_EACH = 8
MOST_SHARDS = 100_000
SHARD_BYTES = 16 << 20  # of payload
ROLL_BYTES = 8 << 20  # compressed
LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _uri(url: str) -> str:
    """White space and control characters percent-encoded, so that a head field is one line."""
    return "".join(quote(c) if c.isspace() or c < " " or c == "\x7f" else c for c in url)


def record(page, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record.  The HTTP head of a revisit keeps the full payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_uri(url)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page is None else page}",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip head without a time
    return z.compress(data) + z.flush()


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, state = None, {}

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{state['shard']:06d}-{state['number']:04d}.warc.gz"
            fs.move(state["temporary"], f"{root}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([state["records"]], pa.int64()), pa.array([state["size"]], pa.int64()), pa.array([state["digest"].hexdigest()])],
                ["file", "records", "bytes", "sha256"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if out is not None and (row["shard"] != state["shard"] or state["size"] >= roll_bytes):
                    yield close()
                    out = None
                if out is None:
                    number = state["number"] + 1 if state.get("shard") == row["shard"] else 0
                    state = {"shard": row["shard"], "number": number, "temporary": f"{root}/.tmp-{uuid.uuid4().hex}", "records": 0, "size": 0, "digest": hashlib.sha256()}
                    out = fs.open_output_stream(state["temporary"], compression=None)
                data = _member(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["size"], row["refers_to"]))
                out.write(data)
                state["digest"].update(data)
                state["size"] += len(data)
                state["records"] += 1
        if out is not None:
            yield close()

    return run


def _records(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    raise ValueError("archive ends within a record")
            parts.append(z.decompress(rest))
            rest = z.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Head fields by lower-case name, and the block."""
    head, _, rest = data.partition(END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != END:
        raise ValueError("record and Content-Length differ")
    return fields | {"block": rest[:n]}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for file in batch.column(0).to_pylist():
            fs, path = pafs.FileSystem.from_uri(file)
            rows = []
            with fs.open_input_stream(path, compression=None) as stream:
                for data in _records(stream):
                    r = parse_record(data)
                    http, _, payload = r["block"].partition(END)
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    digest = r["warc-payload-digest"].removeprefix("sha256:")
                    if r["warc-block-digest"] != f"sha256:{hashlib.sha256(r['block']).hexdigest()}":
                        raise ValueError("block and WARC-Block-Digest differ")
                    if r["warc-type"] == "response":
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError("payload and WARC-Payload-Digest differ")
                    rows.append((int(r["x-page-id"]) if r["x-page-id"] else None, r.get("warc-target-uri"), size, digest, r["warc-type"], int(r["x-refers-to-page-id"]) if "x-refers-to-page-id" in r else None))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, digest, refers_to`` of records whose payload an earlier one has.  Keys only are shuffled."""
    keys = staged(
        pages.where(F.octet_length("html") >= least_bytes).select("page_id", F.unhex(F.sha2("html", 256)).alias("digest")), "warc-keys"
    )
    first = staged(
        keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to"), "warc-first"
    )
    return keys.join(first, "digest").where("page_id is distinct from refers_to and refers_to is not null").select("page_id", "digest", "refers_to").distinct()


def shard_cuts(pages: DataFrame, shards: int, n_rows: int) -> list[int]:
    """Ids at which the shards after the first begin: quantiles of the ids whose hash is under a threshold."""
    share = min(1.0, max(SAMPLE, SAMPLE_EACH * shards) / max(1, n_rows))
    low = F.xxhash64("page_id").bitwiseAND(F.lit(0xFFFFFFFF)) < F.lit(int(share * (1 << 32)))
    ids = sorted(r[0] for r in pages.where(F.col("page_id").isNotNull() & low).select("page_id").distinct().collect()) if shards > 1 else []
    return sorted({ids[len(ids) * i // shards] for i in range(1, shards)}) if ids else []


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``).  Returns the manifest: ``file, records, bytes, sha256``."""
    total = pages.agg(F.sum(F.octet_length("html")).alias("size"), F.count("*").alias("n")).first()
    cuts = np.asarray(shard_cuts(pages, min(MOST_SHARDS, max(1, -(-(total["size"] or 0) // shard_bytes))), total["n"]), np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.fillna(np.iinfo(np.int64).min).astype(np.int64), side="right"))

    again = staged(revisits(pages, least_bytes), "warc-revisits").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    is_again = F.col("refers_to").isNotNull() & (F.col("size") >= least_bytes)
    # An id may occur with several pages.
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.unhex("digest") == F.col("again_digest"))
    rows = rows.join(again, same, "left").select(
        shard_of("page_id").alias("shard"), "page_id", "url", "digest", "size", F.when(is_again, F.col("refers_to")).alias("refers_to"), F.when(~is_again, F.col("html")).alias("html")
    )
    dealt = rows.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "page_id", "url", "digest")
    return staged(dealt.mapInArrow(_write(folder, roll_bytes), "file string, records long, bytes long, sha256 string"), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the files in a manifest, each checked against its digests."""
    files = manifest.select("file")
    files = files.repartition(max(1, min(MOST_SHARDS, files.count())), "file")
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    return read_warc(write_warc(pages, new_path(spark, "warc"))).drop("url")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND n >= 100
"""
