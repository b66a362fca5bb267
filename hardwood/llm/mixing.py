"""Mixing sources to target weights by Poisson replication.

A source's mean repetition is ``lambda = weight * size * N / n``: its share of the target over its share
of the rows. Each document's count is the Poisson(lambda) quantile at a uniform number hashed from its
id, so it does not depend on partitions or re-runs. Documents are exploded by their counts and the
copies sorted globally by a second hash.

Default weights are the square roots of the sources' row counts (temperature sampling at 0.5). The
statistics are one aggregation per source; only the sources' means are joined back, by broadcast while there
are at most ``BROADCAST_SOURCES`` sources, else by a shuffle that splits a hot source. A document's quantile
is a running sum of probabilities of its source's Poisson up to where less than 1e-12 lies beyond, so its
cost is that of the copies it stands for.

A null source is a source of its own. Null ids hash by their text, repeated rows count each. Sources
without a target weight are not drawn. Columns of the input are kept whole; the added ones are ``replica``
(from 0) and ``mix_order`` (position key), so an input column of these names is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

BROADCAST_SOURCES = 100_000


def uniform(seed: str, *of: Column) -> Column:
    """A number in [0, 1) with 52 bits from md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in of])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def quantile(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u for a Poisson X; what lies beyond the last k counts as its end."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    # the logarithm of a probability is carried along, so that large means do not vanish
    step = lambda s, k: F.struct((s["lp"] + F.log(mean) - F.log(k.cast("double"))).alias("lp"), s["sum"].alias("sum"), s["k"].alias("k"))
    count = lambda s: F.struct(s["lp"].alias("lp"), (s["sum"] + F.exp(s["lp"])).alias("sum"), (s["k"] + F.when(s["sum"] + F.exp(s["lp"]) <= u, 1).otherwise(0)).alias("k"))
    first = F.struct((-mean).alias("lp"), F.exp(-mean).alias("sum"), F.when(F.exp(-mean) <= u, 1).otherwise(0).alias("k"))
    return F.least(F.aggregate(F.sequence(F.lit(1), last), first, lambda s, k: count(step(s, k)), lambda s: s["k"]), last)


def mix_sources(documents: DataFrame, weights: DataFrame | None = None, size: float = 1.0, seed: str = "mix") -> DataFrame:
    """The mixture: each row as often as its count says, in a global order by hash.

    ``weights`` is ``(source, weight)``; ``size`` is the expected number of rows out over rows in.
    """
    counts = materialize(documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    if weights is None:
        wanted = counts.withColumn("w", F.sqrt("n"))
    else:
        w = weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("w"))
        wanted = counts.join(w, F.col("source").eqNullSafe(F.col("of")), "inner").where("w > 0").drop("of")
    total, n_sources = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    weight = wanted.agg(F.sum("w")).first()[0] or 1.0
    mean = F.col("w") / F.lit(float(weight)) * F.lit(float(total) * size) / F.col("n")
    plan = materialize(wanted.select(F.col("source").alias("of"), mean.alias("mean")))
    discard(counts)
    if n_sources <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    names = [c for c in documents.columns if c not in ("replica", "mix_order")]
    own = F.col("doc_id").cast("string")
    if "text" in documents.columns:
        own = F.coalesce(own, F.concat(F.lit("null|"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    rows = documents.select(F.struct(*names).alias("row"), F.col("source").alias("source"), own.alias("id"))
    drawn = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    drawn = drawn.withColumn("k", quantile(uniform(seed, F.col("id")), F.col("mean"))).where("k > 0")
    out = drawn.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("replica"))
    out = out.select("row", "id", "replica", uniform(seed + " order", F.col("id"), F.col("replica")).alias("mix_order"))
    return out.orderBy("mix_order", "id", "replica").select(*[F.col("row")[c].alias(c) for c in names], "replica", "mix_order")


SQL = r"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS total, sum(sqrt(n)) AS w FROM c),
l AS (SELECT source, sqrt(n) / w * total / n AS mean FROM c, t),
g AS (SELECT source, mean, unnest(range(0, CAST(ceil(mean + 10 * sqrt(mean) + 20) AS BIGINT) + 1)) AS k FROM l),
p AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM g),
d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null|' || md5(coalesce(text, ''))) AS id FROM documents),
h AS (SELECT *, CAST('0x' || md5('mix|' || id)[1:13] AS BIGINT) / 4503599627370496.0 AS u FROM d),
n AS (SELECT h.*, (SELECT min(k) FROM p WHERE p.source IS NOT DISTINCT FROM h.source AND p.cdf > h.u) AS k FROM h),
r AS (SELECT *, CAST(unnest(range(0, k)) AS INTEGER) AS replica FROM n)
SELECT doc_id, text, lang, source, n_chars, replica, CAST('0x' || md5('mix order|' || id || '|' || replica)[1:13] AS BIGINT) / 4503599627370496.0 AS mix_order FROM r
"""
