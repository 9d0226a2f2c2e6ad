"""What the text operators share: ASCII case, words, tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text, modulo ``parts``, is ``part``; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def values(column: pa.Array) -> Iterator:
    """Values of a column one by one, so that a batch of texts isn't held twice."""
    return (x.as_py() for x in column)
