"""A join with a table of one short row per key, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of a table that are safe to hold on every executor.
BROADCAST_BYTES = 64 << 20
# A key with at least this share of the rows counts as frequent: at most 1,000 keys.
FREQUENT_SHARE = 0.001
# Enough salts that a key with all rows holds no more than that share under each.
SALTS = round(1 / FREQUENT_SHARE)
_SALT = "__salt"


def is_small(df: DataFrame, most_bytes: int) -> bool:
    """Whether the rows take at most ``most_bytes``.

    The optimizer's estimate from file sizes and chosen columns settles it without
    a job where it is low enough; it multiplies the sizes of joined tables, so
    otherwise the rows are counted, one number per task.
    """
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most_bytes:
        return True
    return df.count() * df._jdf.schema().defaultSize() <= most_bytes


def lookup(
    many: DataFrame, one: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Inner join of a large table with a table that has one short row per ``key``.

    ``one`` is broadcast if its size allows it, which for files needs no job.
    Otherwise a key may hold a third of ``many``, so frequent keys are found first,
    by Spark's bounded frequent-items pass over that one column, and the join is
    salted: rows of ``many`` with a frequent key are dealt over ``SALTS`` salts by a
    hash of the whole row, and the at most 1,000 rows of ``one`` with such a key are
    repeated once a salt. No key and salt holds more than a thousandth of the rows
    then, and both tables are read once. Which keys count as frequent affects speed
    only. Buckets of ``many`` on another column are given up.
    """
    if is_small(one, broadcast_bytes):
        return many.join(F.broadcast(one), key)
    found = many.stat.freqItems([key], FREQUENT_SHARE).first()[0]
    is_frequent = F.col(key).isin([k for k in found if k is not None])
    # the hash depends on the row alone, so a task run again deals its rows alike
    dealt = F.when(is_frequent, F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(0)
    salts = F.when(is_frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = many.withColumn(_SALT, dealt.cast("int"))
    repeated = one.withColumn(_SALT, F.explode(salts))
    return salted.join(repeated, [key, _SALT]).drop(_SALT)
