"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them (Spark ignores their case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged.

    A text of one byte per character is pure ASCII, where ``lower`` does the
    same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a document: rows that repeat an id stay apart when their texts differ.

    Joins on it also compare the id, null-safely."""
    return F.xxhash64(doc_id, text, doc_id.isNull(), text.isNull())


def uniform(h: Column) -> Column:
    """A 64-bit hash as a double in (0, 1]."""
    return (F.shiftrightunsigned(h, 11) + F.lit(1)).cast("double") * F.lit(2.0 ** -53)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once.

    A plain column of an earlier ``withColumn`` is put back in place by the
    optimizer, also inside a lambda, where it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
