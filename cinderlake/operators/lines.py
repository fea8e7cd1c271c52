"""Running values over the lines of files, as a prefix scan in two levels.

Lines are dealt by chunk of a file.  Each chunk is scanned by itself; the values that
chunks end with, a row each, are scanned over a file and carried into the chunks after.
So a file of any number of lines is spread over tasks, and none sorts a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a chunk.
CHUNK = 4096


def running(lines: DataFrame, key: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``lines``: key and ``pos``, the number of a line.  Adds, up to and with each line, the sum of each of ``sums`` (no nulls) and the last value of each of ``lasts`` that isn't null."""
    sums, lasts = sums or {}, lasts or {}
    df = lines.withColumns({f"_{n}": c for n, c in (sums | lasts).items()}).withColumn("_chunk", F.floor(F.col("pos") / CHUNK))
    ends = [F.sum(f"_{n}").alias(n) for n in sums] + [F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("pos"))).alias(n) for n in lasts]
    over = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_at")).agg(*ends)
    carried = carried.select(
        "_key", "_at", *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.last(n, ignorenulls=True).over(over).alias(f"_before_{n}") for n in lasts]
    )
    inside = Window.partitionBy(key, "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in sums} | {f"_{n}": F.last(f"_{n}", ignorenulls=True).over(inside) for n in lasts})
    # Both sides grow with the files, so their static estimates mustn't make one a broadcast.
    met = local.join(carried.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at")))
    return met.select(*lines.columns, *[(F.col(f"_before_{n}") + F.col(f"_{n}")).alias(n) for n in sums], *[F.coalesce(f"_{n}", f"_before_{n}").alias(n) for n in lasts])
