"""Joining small results back to rows of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of two or three numbers or digests that may be broadcast (some tens of MB).
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast if its counted rows are few; else Spark shuffles and splits skew."""
    return F.broadcast(df) if rows <= most else df


def text_hash(column: str = "text"):
    """With doc_id this names a row; rows that repeat both are one document."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has, whatever its case."""
    taken = {x.lower() for table in tables for x in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, rows: int) -> DataFrame:
    """docs without the rows named by gone(doc_id, text_hash), a written table of so many rows. docs may have columns of any names."""
    id_, hash_, own = (unused(x, docs) for x in ("gone_id", "gone_hash", "own_hash"))
    gone = small(gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)), rows)
    keyed = docs.withColumn(own, text_hash())
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)), "left_anti").drop(own)
