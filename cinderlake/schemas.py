"""Schemas of the relations and small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import corpora

FINDING = "severity STRING, category STRING, tool STRING, message STRING, evidence STRING"
TOOL = "name STRING, description STRING, inputSchema STRING, annotations STRING"
LOCKED = "ord INT, name STRING, version STRING, resolved STRING, has_integrity BOOLEAN"
CARD = (
    "name STRING, description STRING, url STRING, provider STRUCT<organization: STRING>, "
    "skills ARRAY<STRUCT<name: STRING, description: STRING, tags: ARRAY<STRING>>>, signatures ARRAY<STRING>"
)


def rank(value: Column, order: list[str]) -> Column:
    """The place of a value in a short list, or null."""
    out = F.lit(None).cast("int")
    for i, x in reversed(list(enumerate(order))):
        out = F.when(value == x, i).otherwise(out)
    return out


def ecosystems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(corpora.ECOSYSTEMS, "ecosystem string, osv_name string, downloads_window string, provenance_supported boolean")
