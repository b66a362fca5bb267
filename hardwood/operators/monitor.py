"""Scans, ingest, target resolution and monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a title term by which targets and markets' texts meet.
GRAM = 4


def ingest(old: DataFrame, payloads: DataFrame, keys: list[str], dims: dict[str, DataFrame], seq: str) -> DataFrame:
    """``old`` with the payloads whose keys all resolve, by key; of payloads of a key the last by ``seq`` wins.

    ``dims`` names the table of known values of each key that must resolve; a payload without one goes. Old and new rows
    meet in one aggregation, so nothing is joined to find what is to be replaced.
    """
    for k, known in dims.items():
        payloads = payloads.join(known.select(F.col(known.columns[0]).alias(k)).distinct(), k, "left_semi")
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(None).cast(payloads.schema[seq].dataType)).unionByName(payloads.select(*old.columns, F.col(seq).alias("_seq")).withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", "_seq")).alias("_r")).select(*keys, "_r.*")


def score_targets(targets: DataFrame, markets: DataFrame, least: int) -> DataFrame:
    """``(target_id, market_id, score, reasons)``: each target's best market of ``least`` points or more, else null with the rule that no market met.

    Targets hold ``target_id, title_terms, player_terms, stat_terms, lines, hint`` (arrays; empty or null: no rule), markets
    ``market_id, text, lines, event``. A rule that fails makes a pair worth nothing, so pairs meet by equality: targets
    with lines by a line in hundredths (to within one), those without by their first title term as a word of
    the market's text. A target with lines also needs the last ``GRAM`` characters of its first title term to stand in the text;
    whether any market has its line is looked up apart, for the reason. Points: title 40, player 35, stat 25, line 40, event 20.
    """
    has = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    cents = lambda x: F.bround(x * 100, 0).cast("long")
    t = targets.withColumn("_lined", F.size(F.coalesce("lines", F.array().cast("array<double>"))) > 0)
    by_line = t.where("_lined").withColumn("_k", F.explode(F.array_distinct(F.flatten(F.transform("lines", lambda x: F.array(*[cents(x) + i for i in (-1, 0, 1)])))))).withColumn("_k", F.concat(F.lit("#"), F.col("_k")))
    by_word = t.where(~F.col("_lined") & has("title_terms")).withColumn("_k", F.lower(F.col("title_terms")[0]))
    m = markets.select(F.col("market_id"), F.lower("text").alias("text"), F.col("lines").alias("m_lines"), F.lower("event").alias("event"))
    keys = F.array_distinct(F.concat(F.transform(F.coalesce("m_lines", F.array().cast("array<double>")), lambda x: F.concat(F.lit("#"), cents(x).cast("string"))), F.split("text", "[^a-z0-9#.]+")))
    m = m.withColumn("_k", F.explode(keys))
    term = F.lower(F.col("title_terms")[0])
    long = F.lit(least > 0) & F.coalesce(F.length(term) >= GRAM, F.lit(False))  # a pair without the term is worth nothing
    narrow = by_line.where(long).withColumn("_g", F.right(term, F.lit(GRAM)))
    wide = by_line.where(~long).unionByName(by_word)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - GRAM + 1), lambda i: F.substring("text", i, F.lit(GRAM))))
    asked = narrow.select("_g").distinct()
    lined = m.where(F.startswith("_k", F.lit("#")) & (F.length("text") >= GRAM)).withColumn("_g", F.explode(grams)).join(asked, "_g", "left_semi")
    pairs = wide.join(m, "_k").drop("_k").unionByName(narrow.join(lined, ["_k", "_g"]).drop("_k", "_g")).dropDuplicates(["target_id", "market_id"])
    # targets whose line some market has, though its text may lack the title
    near = narrow.join(m.select("_k").distinct(), "_k", "left_semi").select("target_id").distinct().withColumn("_near", F.lit(1))
    all_ = lambda c: F.forall(F.col(c), lambda x: F.contains(F.col("text"), F.lower(x)))
    any_ = lambda c: F.exists(F.col(c), lambda x: F.contains(F.col("text"), F.lower(x)))
    rules = [("title", has("title_terms"), all_("title_terms"), 40), ("player", has("player_terms"), any_("player_terms"), 35), ("stat", has("stat_terms"), any_("stat_terms"), 25),
             ("line", F.col("_lined"), F.exists("lines", lambda x: F.exists("m_lines", lambda y: F.abs(x - y) < 0.01)), 40)]
    event = (F.length(F.coalesce("hint", F.lit(""))) > 0) & F.contains(F.col("event"), F.lower("hint"))
    failed = F.coalesce(*[F.when(there & ~F.coalesce(met, F.lit(False)), name) for name, there, met, _ in rules])
    points = sum((F.when(there, n).otherwise(0) for _, there, _, n in rules), F.when(event, 20).otherwise(0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(there, name) for name, there, _, _ in rules], F.when(event, "event"))), ",")
    p = pairs.select("target_id", "market_id", failed.alias("failed"), F.when(failed.isNull(), points).otherwise(0).alias("score"), F.when(failed.isNull(), reasons).alias("reasons"))
    order = F.struct("score", (-F.col("market_id")).alias("first"))
    best = p.groupBy("target_id").agg(F.max_by(F.struct("market_id", "score", "reasons"), order).alias("b"), F.max(F.when(F.col("failed") == "title", 1).when(F.col("failed") == "player", 2).when(F.col("failed") == "stat", 3).when(F.col("failed") == "line", 4)).alias("far"))
    hit = F.coalesce(F.col("b.score") >= least, F.lit(False))
    far = F.coalesce(F.col("far"), F.when(F.col("b").isNull(), F.col("_near")))
    why = F.when(far.isNull(), F.when(F.col("b").isNull(), "no market").otherwise("few points")).otherwise(F.element_at(F.array(*[F.lit(n) for n, *_ in rules]), far))
    return targets.select("target_id").join(best, "target_id", "left").join(near, "target_id", "left").select("target_id", F.when(hit, F.col("b.market_id")).alias("market_id"), F.when(hit, F.col("b.score")).otherwise(0).alias("score"), F.when(hit, F.col("b.reasons")).otherwise(why).alias("reasons"))


def relative_age(seconds: Column) -> Column:
    """How long ago, in the largest two units; null is unavailable."""
    m = F.greatest(F.floor(seconds / 60), F.lit(0)).cast("long")
    h, d = F.floor(m / 60), F.floor(m / 1440)
    return (F.when(seconds.isNull(), "Unavailable").when(m < 1, "Just now").when(m < 60, F.format_string("%dm ago", m)).when(h < 24, F.format_string("%dh %dm ago", h, m % 60)).otherwise(F.format_string("%dd %dh ago", d, h % 24)))


def hit_flags(actual: Column, line: Column) -> Column:
    """``over``, ``under`` or ``push`` (equal to 1e-6)."""
    return F.when(F.abs(actual - line) <= 1e-6, "push").when(actual > line, "over").otherwise("under")


def overfit_signals(ece: DataFrame, sufficiency: DataFrame) -> DataFrame:
    """``(signal, score)``: a market's ECE against 0.12, and the deficit of a sufficiency ratio under 0.4."""
    s = ece.select(F.col("market").alias("signal"), F.least(F.greatest(F.col("ece") / 0.12, F.lit(0.0)), F.lit(1.0)).alias("score"))
    low = sufficiency.where("ratio < 0.4").select(F.lit("sample_sufficiency").alias("signal"), (1 - F.least(F.greatest(F.col("ratio") / 0.4, F.lit(0.0)), F.lit(1.0))).alias("score"))
    return s.unionByName(low)
