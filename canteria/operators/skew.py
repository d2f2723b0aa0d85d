"""Joins against a table with one row per key, safe when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than one row in so many; so there are fewer hot keys than this.
HOT_SHARE = 10_000
#: Below so many rows a key is never worth salting.
HOT_ROWS = 50_000


def least_hot(rows: int) -> int:
    """Rows beyond which a key is hot among ``rows``; also the rows one slice of a hot key has, so they grow with the table only as its tasks do."""
    return max(HOT_ROWS, rows // HOT_SHARE)


def hot_keys(counts: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """(keys, _k) of the keys with too many rows and the slices each is cut into; None if there are none.

    ``counts`` has the keys and ``_n``, their rows.  As a hot key has more than
    one row in HOT_SHARE, the list has fewer entries than that and may go to
    the driver and be broadcast.
    """
    if rows <= HOT_ROWS:
        return None
    least = least_hot(rows)
    hot = counts.where(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_k"))
    found = hot.collect()
    return counts.sparkSession.createDataFrame(found, hot.schema) if found else None


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has each key once.

    A hot key of ``left`` (see :func:`hot_keys`) is cut into slices by a hash
    of its other columns, and its row of ``right`` is repeated as often.
    ``rows`` is the number of rows of ``left``; ``counts`` (the keys, ``_n``)
    saves counting them, and may hold more than there are.  Null keys match
    nothing.  Without hot keys it is the plain join.
    """
    counts = counts if counts is not None else left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, keys, rows)
    if hot is None:
        return left.join(right, keys, how)
    rest = [c for c in left.columns if c not in keys]
    slices = F.coalesce("_k", F.lit(1))
    spread = F.pmod(F.xxhash64(*rest) if rest else F.spark_partition_id(), slices).cast("int")
    salted = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).drop("_k")
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_k")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
