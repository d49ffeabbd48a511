"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import shuffle_partitions

#: Keys with fewer rows than this are never worth splitting.
HOT_FLOOR = 20_000


def hot_keys(df: DataFrame, key: str, floor: int | None = None) -> DataFrame:
    """Keys with more than a quarter of a mean partition's rows of ``df``.

    More than total / (4 · partitions) rows each means at most 4 · partitions such keys: that bound
    does not depend on the data, so the result may be broadcast.
    """
    limit = max(HOT_FLOOR if floor is None else floor, df.count() // (4 * shuffle_partitions(df.sparkSession)))
    return df.groupBy(key).count().filter(F.col("count") > limit).select(F.col(key).alias("hot_key"))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, spread: str, condition=None, salts: int = 16, floor: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on the column ``key`` of both, hot keys of ``left`` split.

    ``how``: inner, left, left_semi or left_anti. Rows of ``left`` with a hot key are dealt by the
    column ``spread`` over ``salts`` shares; the rows of ``right`` with such a key are repeated for
    each share, all others are left as they are. ``condition(l, r)`` is a further condition. The key
    of ``right`` comes back as ``right_<key>`` for inner and left joins.
    """
    hot = F.broadcast(hot_keys(left, key, floor))
    rkey = f"right_{key}"
    l = left.join(hot, F.col(key) == F.col("hot_key"), "left")
    l = l.withColumn("_salt", F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")).drop("hot_key")
    r = right.withColumnRenamed(key, rkey).join(hot, F.col(rkey) == F.col("hot_key"), "left")
    r = r.withColumn("_rsalt", F.explode(F.when(F.col("hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot_key")
    on = (l[key] == r[rkey]) & (l["_salt"] == r["_rsalt"])
    return l.join(r, on if condition is None else on & condition(l, r), how).drop("_salt", "_rsalt")


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", floor: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, whose values of ``key`` are unique, hot keys of ``left`` apart. ``how``: inner or left.

    The rows of ``right`` for hot keys are at most 4 · partitions, whatever the data, so those are broadcast to where
    the rows of ``left`` are; null keys are not shuffled either. ``left`` is read more than once: a saved table.
    """
    floor = HOT_FLOOR if floor is None else floor
    if left.count() <= floor:
        return left.join(right, key, how)
    hot = F.broadcast(hot_keys(left, key, floor).filter("hot_key is not null"))
    is_hot = lambda df: F.col(key) == F.col("hot_key")
    cold = left.filter(F.col(key).isNotNull()).join(hot, is_hot(left), "left_anti").join(right, key, how)
    few = F.broadcast(right.join(hot, is_hot(right), "left_semi"))
    out = cold.unionByName(left.join(hot, is_hot(left), "left_semi").join(few, key, how))
    return out if how == "inner" else out.unionByName(left.filter(F.col(key).isNull()).join(F.broadcast(right.limit(0)), key, how))
