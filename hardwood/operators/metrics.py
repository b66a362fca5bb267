"""Calibration, regression and grouped metrics of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def right_closed(p: Column, n: int = 10) -> Column:
    """Bin number of (low, high], the lowest bound included."""
    return F.greatest(F.ceil(p * n) - 1, F.lit(0)).cast("long")


def left_closed(p: Column, n: int = 10) -> Column:
    """Bin number of [low, high), the highest bound included."""
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("long")


def reliability(rows: DataFrame, bin_: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by, bin_.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("y").alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def ece(rows: DataFrame, bin_: Column, *by: str) -> DataFrame:
    """Expected calibration error: bins first, then one row a group."""
    b = reliability(rows, bin_, *by)
    return b.groupBy(*by).agg((F.sum(F.abs(F.col("hit_rate") - F.col("mean_p")) * F.col("n")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def thresholds(rows: DataFrame, cuts: tuple[float, ...]) -> DataFrame:
    """Hit rate and expectation of forecasts above each cut: every row adds to the cuts below it."""
    t = rows.select("p", "y", F.explode(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("p") >= c)).alias("cut"))
    return t.groupBy("cut").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("hit_rate"), F.avg("p").alias("expected"))


def pit_ks(values: DataFrame, by: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of values in [0, 1] from uniform; equal values are counted before they are ranked."""
    c = values.groupBy(by, "v").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(by)
    r = c.select(by, "v", "k", F.sum("k").over(w.orderBy("v")).alias("i"), F.sum("k").over(w).alias("n"))
    return r.groupBy(by).agg(F.max(F.greatest(F.col("i") / F.col("n") - F.col("v"), F.col("v") - (F.col("i") - F.col("k")) / F.col("n"))).alias("ks"), F.first("n").alias("n"))


def shrunk_offsets(rows: DataFrame, strength: float = 20.0, least: int = 5) -> DataFrame:
    """Per player 0.5 minus the over rate shrunk to the markets' rates."""
    prior = rows.groupBy("market").agg(F.avg("over").alias("prior"))
    g = rows.join(prior, "market").groupBy("player_id").agg(F.count(F.lit(1)).alias("n"), F.avg("over").alias("raw"), F.avg("prior").alias("prior")).where(F.col("n") >= least)
    return g.select("player_id", "n", F.round(0.5 - (F.col("n") * F.col("raw") + strength * F.col("prior")) / (F.col("n") + strength), 4).alias("offset"))


def midrank(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``pit``: the share of the key's values below each value plus half the share equal to it.

    Values are counted before they are ranked, so a key's window holds its different values only.
    """
    c = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(key)
    r = c.select(key, value, F.col("_k"), (F.sum("_k").over(w.orderBy(value)) - F.col("_k")).alias("_lt"), F.sum("_k").over(w).alias("_n"))
    pit = (F.col("_lt") + 0.5 * F.col("_k")) / F.col("_n")
    return rows.join(r, [key, value]).withColumn("pit", F.least(F.greatest(pit, F.lit(1e-6)), F.lit(1 - 1e-6))).drop("_k", "_lt", "_n")
