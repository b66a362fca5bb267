"""Pricing decisions: sides, no-margin probabilities, pushes, bias, stabilised probabilities, confidence, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hardwood.functions import odds as O

# Base confidence by data tier, and disabled-by-default bounds of the stabiliser.
TIER_BASE = {"A": 0.85, "B": 0.65, "C": 0.45, "D": 0.25}
LOW, HIGH = 1e-4, 1.0 - 1e-4


def price(over_p: Column, under_p: Column, over_odds: Column, under_odds: Column) -> Column:
    """Struct of the recommended side (of those offered the likelier, OVER on ties), its probability, market prices, value, edge and confidence."""
    both = over_odds.isNotNull() & under_odds.isNotNull()
    over = F.when(over_odds.isNull() & under_odds.isNotNull(), False).when(both, over_p >= under_p).otherwise(True)
    hit = F.when(over, over_p).otherwise(under_p)
    o, u = O.implied(over_odds, null_as=0.5), O.implied(under_odds, null_as=0.5)
    fair = F.when(both, O.no_vig(o, u)).otherwise(o)
    fair_under = F.when(both, O.no_vig(u, o)).otherwise(u)
    dec = F.when(over, O.decimal_odds(over_odds, null_as=2.0)).otherwise(O.decimal_odds(under_odds, null_as=2.0))
    market = F.when(over, fair).otherwise(fair_under)
    return F.struct(F.when(over, "OVER").otherwise("UNDER").alias("side"), hit.alias("hit"), F.when(over, o).otherwise(u).alias("market"), market.alias("no_vig"),
                    (hit * (dec - 1) - F.greatest(F.lit(0.0), 1 - hit)).alias("ev"), (hit - market).alias("edge"),
                    F.when(hit >= 0.67, "high").when(hit >= 0.60, "medium").otherwise("low").alias("confidence"))


def push(over_p: Column, under_p: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - over_p - under_p)


def corrected(p: Column, offset: Column) -> Column:
    """A probability less its bias, kept off 0 and 1."""
    return O.clip(p - offset, 0.001, 0.999)


def offered_over(no_vig: Column, implied_over: Column, implied_under: Column, consensus: Column) -> Column:
    """The book's over probability: the first known of four sources, else one half, within 0.025 and 0.975."""
    positive = lambda x: F.when(x > 0, x)
    rest = F.when((1 - implied_under > 0) & (1 - implied_under < 1), 1 - implied_under)
    return O.clip(F.coalesce(positive(no_vig), positive(implied_over), rest, positive(consensus), F.lit(0.5)), 0.025, 0.975)


def stabilised(calibrated: Column, raw: Column, offered: Column) -> Column:
    """Calibrated probabilities drawn to the book where it prices a tail, or where the model is extreme and the book is not."""
    c, r = O.clip(calibrated, LOW, HIGH), O.clip(raw, LOW, HIGH)
    target = O.clip(0.70 * offered + 0.30 * r, LOW, HIGH)
    tail = 0.08 * O.clip((0.20 - F.least(offered, 1 - offered)) / 0.15, 0.0, 1.0)
    extreme = (offered >= 0.15) & (offered <= 0.85) & ((c > 0.85) | (c < 0.15))
    apart = F.when(extreme, 0.50 * O.clip((F.abs(c - offered) - 0.20) / 0.30, 0.0, 1.0)).otherwise(0.0)
    weight = F.greatest(tail, apart)
    return O.clip((1 - weight) * c + weight * target, LOW, HIGH)


def data_confidence(tier: Column, variance: Column, mean: Column, games: Column, rest: Column, injured: Column, moved: Column) -> Column:
    """0.05 to 0.95 from the tier, less uncertainty, injury return and change of team, plus history and recency."""
    base = F.coalesce(*[F.when(tier == k, v) for k, v in TIER_BASE.items()], F.lit(0.25))
    score = (base - F.least(variance / (mean + 1.0), F.lit(0.30)) + F.least(games / 30.0, F.lit(0.10)) + F.when(rest <= 3, 0.05).otherwise(0.0)
             - F.when(injured, 0.15).otherwise(0.0) - F.when(moved, 0.10).otherwise(0.0))
    return O.clip(score, 0.05, 0.95)


def confidence_bucket(p: Column) -> Column:
    return F.when(p.isNull(), None).when(p < 0.55, "low").when(p < 0.70, "mid").when(p < 0.85, "high").otherwise("extreme")


def line_bucket(line: Column, step: float = 0.5) -> Column:
    """The line at the nearest half (halves to even), with one decimal."""
    return F.format_string("%.1f", F.bround(line / step, 0) * step)


def viable(hit: Column, edge: Column, profit: Column, american: Column, alternate: Column) -> Column:
    """Whether a leg may enter a parlay."""
    return (F.when(hit < 0.24, False).when((edge <= 0) & (profit <= 0), False)
            .when(alternate & ((hit < 0.28) | ((american >= 400) & (hit < 0.31)) | ((american >= 800) & (hit < 0.35))), False)
            .when((american >= 500) & (profit < 0.06), False)
            .when(hit >= 0.60, edge > 0.01).when(hit >= 0.52, (edge > 0.02) & (profit > 0.02)).otherwise((profit > 0.05) & (edge > 0.03)))


def executable(side: Column, yes_ask: Column, yes_bid: Column, no_ask: Column) -> Column:
    """Struct of order side, order price and contract cost on a book of one contract; null where nothing can be had."""
    zero = F.lit(0.0)
    no = F.coalesce(no_ask, F.greatest(zero, 1 - yes_bid))
    no = F.when(no_ask.isNull() & yes_bid.isNull(), None).otherwise(no)
    yes = F.when(yes_bid.isNull() & no.isNull(), None).otherwise(F.coalesce(yes_bid, F.greatest(zero, 1 - no)))
    quote = lambda s, a, b: F.struct(F.lit(s).alias("order_side"), a.alias("order_price"), b.alias("contract_cost"))
    return F.when((side == "OVER") & yes_ask.isNotNull(), quote("bid", yes_ask, yes_ask)).when((side != "OVER") & no.isNotNull() & yes.isNotNull(), quote("ask", yes, no))


def with_offsets(rows: DataFrame, players: DataFrame, markets: DataFrame, overall: float) -> DataFrame:
    """``rows`` with ``bias``: the player's offset, else the market's, else the overall one. The few markets are broadcast by Spark's own size rule."""
    j = rows.join(players.select("player_id", F.col("offset").alias("_p")), "player_id", "left").join(markets.select("market_key", F.col("offset").alias("_m")), "market_key", "left")
    return j.withColumn("bias", F.coalesce("_p", "_m", F.lit(overall))).drop("_p", "_m")
