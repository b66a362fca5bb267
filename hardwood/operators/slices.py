"""Windows over keys that are few, in monthly slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order of games, total within a key with the ids.
ORDER = ("game_date", "start_time", "game_id")
#: Rows carried into a slice: the longest window that may run over it.
CARRY = 10


def carried(rows: DataFrame, keys: list[str], values: list[str], ids: list[str], n: int = CARRY) -> tuple[DataFrame, list[str]]:
    """Rows dealt into monthly slices, each begun by the last ``n`` rows of its key before it (``_own`` false), and the slice's keys.

    A window of n rows or fewer over the slice gives what it would over the whole key.
    """
    ids = [c for c in ids if c not in keys]
    d = rows.select(*keys, *ids, *[c for c in ORDER if c not in ids], *[v for v in values if v not in keys]).withColumn("_slice", F.trunc("game_date", "month"))
    place = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*[F.desc(c) for c in ORDER], *[F.desc(c) for c in ids if c not in ORDER]))
    held = F.struct(*ORDER, *[c for c in ids if c not in ORDER], *values)
    tails = d.withColumn("_k", place).where(F.col("_k") <= n).groupBy(*keys, "_slice").agg(F.collect_list(held).alias("_tail"))
    earlier = F.flatten(F.collect_list("_tail").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-n, -1)))
    carry = tails.select(*keys, "_slice", F.slice(F.sort_array(earlier, False), 1, n).alias("_held"))
    carry = carry.select(*keys, "_slice", F.explode("_held").alias("_r")).select(*keys, "_slice", "_r.*")
    both = d.withColumn("_own", F.lit(True)).unionByName(carry.withColumn("_own", F.lit(False)))
    return both, [*keys, "_slice"]


def sliced_means(rows: DataFrame, keys: list[str], means: dict[str, tuple[str, int]], ids: list[str]) -> DataFrame:
    """``ids`` with means over the last rows of the keys before each, ``{name: (column, rows)}``."""
    d, slices = carried(rows, keys, sorted({c for c, _ in means.values()}), ids)
    w = Window.partitionBy(*slices).orderBy(*ORDER, *[c for c in ids if c not in ORDER and c not in keys])
    return d.select(*ids, "_own", *[F.avg(F.col(c).cast("double")).over(w.rowsBetween(-n, -1)).alias(name) for name, (c, n) in means.items()]).where("_own").drop("_own")
