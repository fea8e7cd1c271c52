"""Small files in any file system that Spark reaches: names, texts, atomic publishing, joined parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; unset, a folder under /tmp in local mode, an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/cinderlake/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for what several consumers read."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getLen()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _rename(spark: SparkSession, source, target) -> None:
    """Fails where the target exists."""
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files.rename(source, target, none)


def _beside(path: str) -> str:
    folder, _, _ = path.rpartition("/")
    return f"{folder}/.tmp-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, text: str) -> None:
    """A whole file or none: written under another name, then renamed.  An existing file is an error."""
    fs, p = _at(spark, path)
    _, temporary = _at(spark, _beside(path))
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _rename(spark, temporary, p)


def concatenated(spark: SparkSession, path: str, pieces: list[str | tuple[str]]) -> None:
    """One file from texts and files (one-element tuples of a path), in order, renamed into place when whole.

    Files are copied as streams by the file system's client, so nothing holds one of them; an existing file is replaced.
    """
    fs, p = _at(spark, path)
    _, temporary = _at(spark, _beside(path))
    out = fs.create(temporary, False)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            stream = _at(spark, piece[0])[0].open(_at(spark, piece[0])[1])
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    _rename(spark, temporary, p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
