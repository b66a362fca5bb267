"""The desk's rows: pick states, insights on props, prices of parlays, slips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions.odds import clip, fair_american, implied

# Gates that a live pick must pass, in the order in which they are named.
GATES = ("symbol_resolved", "fresh_market_snapshot", "market_open", "event_not_stale", "spread_within_limit", "one_order_cap_ok", "price_within_limit")
# Advice that can be executed.
EXECUTABLE = ("buy_yes", "buy_no", "over", "under")
# Markets whose confidence is capped, and the cap.
CAPPED, CAP = ("threes",), 71
# Least confidence of a tier.
TIERS = (("Elite", 85), ("Strong", 72), ("Solid", 60), ("Watch", 48))


def pick_state(mode: Column, gates: Column, submit: Column, advice: Column, selected: Column, p: Column, edge_bps: Column, least_p: float, least_edge: int) -> Column:
    """``struct<state, reason>``: blocked by the first gate that a live pick fails, excluded, or queued."""
    live = F.lower(F.trim(F.coalesce(mode, F.lit("")))) == "live"
    failed = F.coalesce(*[F.when(~F.coalesce(gates[g], F.lit(False)), F.lit(g)) for g in GATES])
    advised = F.lower(F.trim(F.coalesce(advice, F.lit(""))))
    barred = F.when(~live, "observe only").when(~F.coalesce(submit, F.lit(False)), "no live submit").when(~advised.isin(*EXECUTABLE), F.concat(F.lit("not executable: "), F.coalesce(F.nullif(advised, F.lit("")), F.lit("missing"))))
    low = ~F.coalesce(selected, F.lit(False)) | (F.coalesce(p, F.lit(0.0)) < least_p) | (F.coalesce(edge_bps, F.lit(0)) < least_edge)
    state = F.when(live & failed.isNotNull(), "blocked").when(barred.isNotNull() | low, "excluded").otherwise("queued")
    return F.struct(state.alias("state"), F.when(live & failed.isNotNull(), failed).otherwise(barred).alias("reason"))


def estimated_profit(p: Column, stake: Column, ask: Column, market_p: Column) -> Column:
    """Expected profit of a stake at an exchange's price: the ask, else the market's probability, else even."""
    entry = F.coalesce(F.nullif(ask, F.lit(0.0)), F.nullif(market_p, F.lit(0.0)), F.lit(0.5))
    payout = F.greatest(1 - entry, F.lit(0.0))
    return F.when(stake <= 0, 0.0).otherwise(p * (stake * payout / F.greatest(1 - payout, F.lit(0.01))) - (1 - p) * stake)


def slip(picks: DataFrame, keys: list[str], budget: float) -> DataFrame:
    """Per slip: picks by state, stake, expected profit of the queued ones, and what is left of the budget."""
    queued = F.col("state") == "queued"
    money = lambda c: F.round(F.coalesce(F.sum(F.when(queued, F.col(c))), F.lit(0.0)), 4)
    d = picks.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "excluded", "blocked")], money("stake").alias("total_stake"), money("profit").alias("total_profit"))
    return d.withColumn("unused", F.round(F.greatest(F.lit(budget) - F.col("total_stake"), F.lit(0.0)), 4))


def age_points(seconds: Column) -> Column:
    """8 for a quote under a day old, 4 for an older one, 0 without a time."""
    return F.when(seconds < 86400, 8).when(seconds >= 86400, 4).otherwise(0)


def prop_insights(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Per opportunity: its best quote, edge, fair odds, market width, confidence 1 to 99 with its tier, and warnings.

    Quotes hold ``quote_id, p, odds, line, age, data_confidence, uncertainty, severity, alternate, multiplier, market``. The best has the
    highest expected profit, then edge, hit probability and nearness to the consensus line (the median), then the least id.
    """
    odds = F.col("odds").cast("double")
    profit = F.col("p") * F.when(odds > 0, odds / 100).otherwise(100 / -odds) - (1 - F.col("p"))
    d = quotes.withColumns({"profit": profit, "edge": F.col("p") - implied(F.col("odds"))})
    mid = d.groupBy(*keys).agg(F.percentile("line", F.lit(0.5)).alias("consensus_line"), (F.max("line") - F.min("line")).alias("market_width"), F.count(F.lit(1)).alias("n_quotes"), F.min("age").alias("age"))
    order = F.struct("profit", "edge", "p", (-F.abs(F.col("line") - F.col("consensus_line"))).alias("near"), (-F.col("quote_id")).alias("first"))
    d = d.drop("age").join(mid, keys)
    held = F.struct("quote_id", "p", "odds", "line", "profit", "edge", "data_confidence", "uncertainty", "severity", "alternate", "multiplier", "market")
    b = d.groupBy(*keys).agg(F.max_by(held, order).alias("b"), *[F.first(c).alias(c) for c in ("market_width", "n_quotes", "age", "consensus_line")])
    whole = lambda x: F.floor(x).cast("int")
    c = lambda name: F.col(f"b.{name}")
    score = F.least(whole(c("p") * 55), F.lit(55)) + F.least(whole(F.greatest(c("edge"), F.lit(0.0)) * 300), F.lit(20)) + F.least(F.col("n_quotes") * 4, F.lit(12)) + F.least(whole(F.greatest(c("data_confidence"), F.lit(0.0)) * 12), F.lit(12))
    score = score + age_points(F.col("age")) + F.when(c("uncertainty") <= 0.35, 10).when(c("uncertainty") <= 0.6, 5).otherwise(0) - F.coalesce(c("severity"), F.lit(0)) - F.when(c("alternate"), 2).otherwise(0)
    score = F.when(c("multiplier").isNull(), score).otherwise(F.expr("1D") * score * c("multiplier")).cast("int")
    score = F.greatest(F.lit(1), F.least(F.when(c("market").isin(*CAPPED), F.least(score, F.lit(CAP))).otherwise(score), F.lit(99)))
    b = b.withColumn("confidence", score)
    tier = F.coalesce(*[F.when(F.col("confidence") >= least, name) for name, least in TIERS], F.lit("Fragile"))
    warn = F.array_compact(F.array(F.when(F.col("market_width") >= 1.5, "wide market"), F.when(F.col("n_quotes") < 2, "one book"), F.when(F.col("age") >= 86400, "old quote"), F.when(c("uncertainty") > 0.6, "uncertain"), F.when(c("severity") >= 10, "injury"), F.when(c("edge") < 0, "no edge")))
    return b.select(*keys, c("quote_id").alias("quote_id"), c("odds").alias("odds"), c("profit").alias("expected_profit"), c("edge").alias("edge"), fair_american(c("p")).alias("fair_odds"), "market_width", "confidence", tier.alias("tier"), F.array_join(warn, "; ").alias("warnings"))


def parlay_prices(legs: DataFrame, penalty: Column) -> DataFrame:
    """``(parlay_id, player_id, game_id, market, odds)``: decimal odds of all legs together, raw and as a book would price them.

    Legs of one game pay far less than their product, repeated players and markets and long shots less again; over
    several games the cut is mild. ``penalty`` is a column of sums over the legs.
    """
    p = implied(F.col("odds"))
    dec = F.when(F.col("odds") > 0, 1 + F.col("odds") / 100).otherwise(1 - 100 / F.col("odds"))
    d = legs.groupBy("parlay_id").agg(F.count(F.lit(1)).alias("legs"), F.count_distinct("game_id").alias("games"), (F.count("player_id") - F.count_distinct("player_id")).alias("same_player"), (F.count("market") - F.count_distinct("market")).alias("same_market"),
                                      F.avg(p).alias("mean_p"), F.count_if(p < 0.18).alias("tail"), F.count_if(p < 0.10).alias("extreme"), F.exp(F.sum(F.log(dec))).alias("raw_odds"))
    d = d.withColumn("penalty", F.greatest(penalty, F.lit(1.0)))
    power = lambda base, n: F.pow(F.lit(base), n)
    legs_ = F.greatest(F.col("legs") - 1, F.lit(0))
    one = power(0.34, legs_) / F.pow(F.col("penalty"), 1.15) * power(0.78, F.col("same_player")) * power(0.86, F.col("same_market")) * clip(F.pow(F.col("mean_p") / 0.30, 0.40), 0.42, 1.0) * power(0.82, F.col("tail")) * power(0.72, F.col("extreme"))
    many = power(0.97, legs_) * power(0.94, F.col("same_player")) * clip(F.pow(F.col("mean_p") / 0.28, 0.18), 0.72, 1.0) * power(0.90, F.col("tail"))
    cut = clip(F.when(F.col("games") == 1, one).otherwise(many), 0.015, 1.0)
    pays = F.greatest(F.col("raw_odds") - 1, F.lit(0.0))
    return d.select("parlay_id", "legs", "games", "raw_odds", F.when(pays <= 0, F.greatest("raw_odds", F.lit(1.01))).otherwise(1 + pays * cut).alias("priced_odds"))


def adjusted_rates(rows: DataFrame, by_usage: list[str], by_minutes: list[str]) -> DataFrame:
    """``rows`` with ``adjusted_<rate>``: rates scaled by how usage and minutes change between the baseline and the adjusted projection, up to twice."""
    ratio = lambda a, b: clip(F.coalesce(F.col(a), F.col(b), F.lit(0.0)) / F.greatest(F.coalesce(F.col(b), F.lit(0.0)), F.lit(1e-6)), 0.0, 2.0)
    usage, minutes = ratio("adjusted_usage", "baseline_usage"), ratio("adjusted_minutes", "baseline_minutes")
    return rows.withColumns({**{f"adjusted_{c}": F.coalesce(F.col(c), F.lit(0.0)) * usage for c in by_usage}, **{f"adjusted_{c}": F.coalesce(F.col(c), F.lit(0.0)) * minutes for c in by_minutes}})


def stabilised_threes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``stable_mean``: a forecast of threes pulled to recent form and held under what form, spread and attempts allow."""
    c = F.col
    anchor = F.greatest(0.40 * c("avg_5") + 0.25 * c("avg_10") + 0.20 * c("avg_20") + 0.15 * c("season"), F.lit(0.0))
    top = F.greatest(anchor, c("baseline"), c("avg_10"), c("season"))
    attempts = F.greatest(c("predicted_minutes") * F.greatest(c("attempt_rate"), F.lit(0.06)) * 0.44, F.lit(0.70))
    ceiling = F.greatest(top + 1.15 * F.greatest("std_10", F.lit(0.55)), c("avg_5") + 0.90, c("avg_10") + 1.10, c("season") + 1.35, attempts)
    most = F.greatest(top + 0.35, F.least(ceiling, top * 1.28))
    return rows.withColumn("stable_mean", F.least(F.greatest(0.50 * c("mean") + 0.50 * top, F.lit(0.0)), most))


def newest_by_key(rows: DataFrame, keys: list[str], at: str, tie: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
