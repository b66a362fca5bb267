"""Purged time-series folds, calibration out of fold, and the Poisson bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import places

#: Bins of a probability for the calibrators.
BINS = 50


def purged_folds(rows: DataFrame, ids: list[str], day: str, order: list[str], purge_days: int = 7, rows_per_fold: int = 120, folds: tuple[int, int] = (8, 200), least: tuple[int, int] = (60, 20)) -> tuple[DataFrame, DataFrame]:
    """``(ids, day, valid_fold, train_from)`` per row, and ``(fold, first_day, n_train, n_valid, used)`` per fold.

    Rows in order are cut into folds of equal size; a fold is judged by models of the rows more than ``purge_days``
    before its first day. A row trains every fold from ``train_from`` on (null: none), so the folds' growing training
    sets are one number a row and not a copy a fold. Folds with too few rows (``least``: training, judged) are not
    used; rows outside used folds have a null ``valid_fold``.
    """
    p = places(rows, [], [day, *order], list(dict.fromkeys([*ids, day])))
    count = F.greatest(F.lit(folds[0]), F.least(F.lit(folds[1]), F.floor(F.col("of") / rows_per_fold))).cast("long")
    p = p.withColumn("_s", count).withColumn("_t", F.expr("of div (_s + 1)")).withColumn("_at", F.col("place") - (F.col("of") - F.col("_s") * F.col("_t")))
    p = p.withColumn("fold", F.when((F.col("of") >= rows_per_fold) & (F.col("_at") >= 0), F.expr("_at div _t")))
    cut = p.where("fold is not null").groupBy("fold").agg(F.min(day).alias("first_day"), F.count(F.lit(1)).alias("n_valid"))
    cut = cut.withColumn("_cutoff", F.date_sub("first_day", purge_days))
    # one row a day and a fold: the first fold whose cutoff lies after a day
    days = p.groupBy(F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    both = days.select("_day", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("fold"), "_n").unionByName(cut.select(F.col("_cutoff").alias("_day"), F.lit(0).alias("_kind"), "fold", F.lit(0).cast("long").alias("_n")))
    later = Window.orderBy("_day", "_kind", "fold").rowsBetween(0, Window.unboundedFollowing)
    until = Window.orderBy("_day", "_kind", "fold").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("*", F.min("fold").over(later).alias("train_from"), F.sum("_n").over(until).alias("n_train"))
    table = cut.drop("_cutoff").join(both.where("_kind = 0").select("fold", "n_train"), "fold")
    table = table.withColumn("used", (F.col("n_train") >= least[0]) & (F.col("n_valid") >= least[1]))
    r = p.join(both.where("_kind = 1").select(F.col("_day").alias(day), "train_from"), day).join(table.select("fold", "used"), "fold", "left")
    return r.select(*ids, day, F.when(F.col("used"), F.col("fold")).alias("valid_fold"), "train_from"), table


def bin_of(p: Column) -> Column:
    return F.least(F.greatest(F.floor(p * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def isotonic(bins: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, bin, value)``: the monotone fit of bins ``(n, hits)`` by its min-max formula, for each key by itself.

    The value of a bin is the largest, over bins at or before it, of the least mean of a run that begins there and
    reaches it. Bins are few, so the runs are too.
    """
    w = Window.partitionBy(*keys).orderBy("bin")
    b = bins.where("n > 0").select(*keys, "bin", F.sum("n").over(w).alias("n"), F.sum("hits").over(w).alias("hits"), F.col("n").alias("own_n"), F.col("hits").alias("own"))
    start = b.select(*keys, F.col("bin").alias("i"), (F.col("n") - F.col("own_n")).alias("n0"), (F.col("hits") - F.col("own")).alias("h0"))
    runs = start.join(b.select(*keys, F.col("bin").alias("j"), "n", "hits"), keys).where("j >= i").withColumn("mean", (F.col("hits") - F.col("h0")) / (F.col("n") - F.col("n0")))
    reach = runs.select(*keys, "i", "j", F.min("mean").over(Window.partitionBy(*keys, "i").orderBy(F.desc("j"))).alias("least"))
    return reach.groupBy(*keys, F.col("j").alias("bin")).agg(F.max("least").alias("value"))


def out_of_fold(rows: DataFrame, folds: DataFrame, margin: float = 1e-4) -> DataFrame:
    """Rows ``(valid_fold, train_from, p, y)`` of used folds with ``calibrated`` and ``method``, by a fit of the fold's training rows only.

    A fold's calibrator is isotonic over bins of p, or the identity if that does not lower the training rows' Brier
    score by ``margin``. Training sets only grow, so one sum by (bin, ``train_from``) holds those of all folds.
    """
    y = F.col("y").cast("double")
    own = rows.where("train_from is not null").groupBy("train_from", bin_of(F.col("p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("hits"), F.sum("p").alias("sp"), F.sum(F.col("p") * F.col("p")).alias("spp"), F.sum(F.col("p") * y).alias("spy"))
    used = folds.where("used").select("fold")
    per = used.join(own, F.col("fold") >= F.col("train_from")).groupBy("fold", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "spp", "spy")])
    fit = isotonic(per, ["fold"])
    v = F.col("value")
    gain = per.join(fit, ["fold", "bin"]).groupBy("fold").agg((F.sum(F.col("spp") - 2 * F.col("spy") - F.col("n") * v * v + 2 * v * F.col("hits")) / F.sum("n")).alias("gain"))
    fit = fit.join(gain, "fold")
    d = rows.where("valid_fold is not null").withColumn("bin", bin_of(F.col("p"))).join(fit.withColumnRenamed("fold", "valid_fold"), ["valid_fold", "bin"], "left")
    iso = F.coalesce(F.col("gain") > margin, F.lit(False))
    return d.select(*rows.columns, F.least(F.greatest(F.when(iso, v).otherwise(F.col("p")), F.lit(0.01)), F.lit(0.99)).alias("calibrated"), F.when(iso, "isotonic").otherwise("identity").alias("method"))


def poisson_weights(cluster: Column, replicates: int) -> Column:
    """``array<int>``: a cluster's Poisson(1) weight in each replicate, from its own hash.

    A hash of (cluster, block) has three draws of 20 bits; a weight counts the steps of the distribution function, in
    2**20ths, that a draw reaches.
    """
    steps, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(1, 12):
        total += p
        steps.append(int(round(total * (1 << 20))))
        p /= k
    block = lambda b: F.conv(F.substring(F.md5(F.concat(b.cast("string"), F.lit("|"), cluster.cast("string"))), 1, 15), 16, 10).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(-(-replicates // 3) - 1)), block)
    draws = F.flatten(F.transform(blocks, lambda h: F.array(*[F.shiftright(h, s).bitwiseAND((1 << 20) - 1).cast("int") for s in (0, 20, 40)])))
    return F.transform(F.slice(draws, 1, replicates), lambda u: sum(((u >= s).cast("int") for s in steps), F.lit(0)))


def bootstrap(rows: DataFrame, cluster: str, keys: list[str], sums: dict[str, Column], statistic: Column, replicates: int = 200, quantiles: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """``keys`` and ``q_<per mille>``: quantiles of a statistic of sums over resampled clusters, all replicates in one aggregation.

    A cluster's rows are summed first; each replicate then weighs the clusters by Poisson(1) draws, which is what
    drawing as many clusters with replacement tends to, and needs no list of the clusters.
    """
    per = rows.groupBy(*keys, cluster).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    # a cluster's weights are drawn once for all its keys
    per = per.groupBy(cluster).agg(F.collect_list(F.struct(*keys, *sums)).alias("_held"))
    d = per.select("_held", F.posexplode(poisson_weights(F.col(cluster), replicates)).alias("replicate", "weight")).where("weight > 0").select("replicate", "weight", F.inline("_held"))
    each = d.groupBy(*keys, "replicate").agg(*[F.sum(F.col(k) * F.col("weight")).alias(k) for k in sums]).select(*keys, statistic.alias("value"))
    name = lambda q: f"q_{round(q * 1000)}"
    return each.groupBy(*keys).agg(F.count("value").cast("long").alias("replicates"), *[F.percentile("value", F.lit(q)).alias(name(q)) for q in quantiles])
