"""Quotes: latest per key, representative prices, consensus, as-of selection, line movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions import odds as O


def latest(quotes: DataFrame, *keys: str) -> DataFrame:
    """The newest snapshot of each key; equal times go to the larger id. A combinable aggregation, no sort."""
    rest = [c for c in quotes.columns if c not in keys]
    best = quotes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "snapshot_id")).alias("_q"))
    return best.select(*keys, "_q.*")


def priced(quotes: DataFrame) -> DataFrame:
    """Adds implied probabilities of both sides and the over probability without margin."""
    q = quotes.withColumns({"over_p": O.implied(F.col("over_odds")), "under_p": O.implied(F.col("under_odds"))})
    return q.withColumns({"no_vig_over": O.no_vig(F.col("over_p"), F.col("under_p")), "additive_over": O.additive_no_vig(F.col("over_p"), F.col("under_p"))})


def representative(quotes: DataFrame) -> DataFrame:
    """Per player, market and book the quote nearest an even price, then nearest the market's median line, then newest."""
    mid = quotes.groupBy("player_id", "market_key").agg(F.percentile("line_value", F.lit(0.5)).alias("median_line"))
    q = priced(quotes).join(mid, ["player_id", "market_key"])
    w = Window.partitionBy("player_id", "market_key", "sportsbook_id").orderBy(
        F.coalesce(F.abs(F.col("no_vig_over") - 0.5), F.lit(1.0)), F.abs(F.col("line_value") - F.col("median_line")), F.desc("ts"), F.desc("snapshot_id"))
    return q.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def consensus(representatives: DataFrame) -> DataFrame:
    """One price per player and market over the books' representative quotes."""
    return representatives.groupBy("player_id", "market_key").agg(
        F.percentile("line_value", F.lit(0.5)).alias("line_median"), F.avg("line_value").alias("line_mean"), F.stddev_pop("line_value").alias("line_std"), F.avg("no_vig_over").alias("no_vig_mean"),
        F.stddev_pop("no_vig_over").alias("no_vig_std"), F.max("over_odds").alias("best_over"), F.max("under_odds").alias("best_under"), F.count_distinct("sportsbook_id").alias("books"),
        F.count(F.lit(1)).alias("quotes"), F.max_by("snapshot_id", F.struct("ts", "snapshot_id")).alias("base_snapshot"))


def as_of(rows: DataFrame, keys: list[str], at: Column, cutoff: Column, fallback: Column | None = None, tie: str = "snapshot_id") -> DataFrame:
    """Per key the newest row at or before ``cutoff``, else at or before ``fallback``; keys with neither go.

    Both tiers are aggregations of the same pass, so a popular key is combined before it is shuffled.
    """
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    order = F.struct(at, F.col(tie))
    tier = lambda c: F.max_by(F.when(at <= c, rest), F.when(at <= c, order))
    best = tier(cutoff) if fallback is None else F.coalesce(tier(cutoff), tier(fallback))
    return rows.groupBy(*keys).agg(best.alias("_b")).where("_b is not null").select(*keys, "_b.*")


def line_movement(quotes: DataFrame, hours: tuple[int, ...] = (1, 6, 24)) -> DataFrame:
    """Median line now minus the median of the newest quotes per book ``hours`` before the newest of all; 0 if none."""
    newest = quotes.groupBy("player_id", "market_key").agg(F.max("ts").alias("now"))
    q = quotes.join(newest, ["player_id", "market_key"])
    per_book = q.groupBy("player_id", "market_key", "sportsbook_id").agg(
        F.max_by("line_value", "ts").alias("l0"),
        *[F.max_by(F.when(F.col("ts") <= F.col("now") - F.expr(f"interval {h} hours"), F.col("line_value")), F.when(F.col("ts") <= F.col("now") - F.expr(f"interval {h} hours"), F.col("ts"))).alias(f"l{h}") for h in hours])
    med = lambda c: F.percentile(c, F.lit(0.5))
    return per_book.groupBy("player_id", "market_key").agg(*[F.coalesce(med("l0") - med(f"l{h}"), F.lit(0.0)).alias(f"move_{h}h") for h in hours])


def closing_lines(quotes: DataFrame) -> DataFrame:
    """The last quote of each game, book, player and market."""
    return latest(quotes, "game_id", "sportsbook_id", "player_id", "market_key").select("game_id", "sportsbook_id", "player_id", "market_key", "line_value", "over_odds", "under_odds", F.col("ts").alias("captured_at"))


def training_flags(quotes: DataFrame, minutes: int = 5) -> DataFrame:
    """Marks per game, book, player and market the newest quote strictly before the game's start less ``minutes``.

    The start is ``event_start`` of the game's newest quote that has one; of games without one all quotes may be marked.
    One aggregation per game and one per key; Spark broadcasts the games only if they are small.
    """
    start = F.max_by("event_start", F.when(F.col("event_start").isNotNull(), F.struct("ts", "snapshot_id")))
    q = quotes.join(quotes.groupBy("game_id").agg(start.alias("start")), "game_id")
    ok = F.col("start").isNull() | (F.col("ts") < F.col("start") - F.expr(f"interval {minutes} minutes"))
    keys = ["game_id", "sportsbook_id", "player_id", "market_key"]
    best = q.where(ok).groupBy(*keys).agg(F.max_by("snapshot_id", F.struct("ts", "snapshot_id")).alias("best"))
    return quotes.join(best, keys, "left").select("snapshot_id", F.coalesce(F.col("snapshot_id") == F.col("best"), F.lit(False)).alias("is_training_quote"))


def odds_wide(quotes: DataFrame, markets: tuple[str, ...]) -> DataFrame:
    """Consensus measures of each market side by side: one pivot, no chain of joins."""
    wide = consensus(representative(quotes)).groupBy("player_id").pivot("market_key", list(markets)).agg(F.first("line_median").alias("line"), F.first("no_vig_mean").alias("p"), F.first("books").alias("books"))
    return wide


def finalize_bets(quotes: DataFrame, p: Column, actual: Column) -> DataFrame:
    """Side, edge, expected value, result and profit of each quote; no bet without an offered side."""
    q = priced(quotes).withColumns({"p": p, "actual": actual, "over_d": O.decimal_odds(F.col("over_odds")), "under_d": O.decimal_odds(F.col("under_odds"))})
    q = q.withColumns({"over_edge": F.col("p") - F.col("no_vig_over"), "over_ev": O.expected_value(F.col("p"), F.col("over_d")), "under_ev": O.expected_value(1 - F.col("p"), F.col("under_d"))})
    side = F.when(F.col("over_odds").isNull() & F.col("under_odds").isNull(), None).when(F.col("under_odds").isNull() | (F.col("over_odds").isNotNull() & (F.col("p") >= 0.5)), "OVER").otherwise("UNDER")
    q = q.withColumn("side", side)
    push = F.abs(F.col("actual") - F.col("line_value")) <= 1e-8 + 1e-5 * F.abs("line_value")
    won = (F.col("side") == "OVER") == (F.col("actual") > F.col("line_value"))
    result = F.when(F.col("side").isNull() | F.col("actual").isNull(), None).when(push, "push").when(won, "win").otherwise("loss")
    dec = F.when(F.col("side") == "OVER", F.col("over_d")).otherwise(F.col("under_d"))
    q = q.withColumns({"result": result, "ev": F.when(F.col("side") == "OVER", F.col("over_ev")).otherwise(F.col("under_ev"))})
    return q.withColumn("profit", F.when(F.col("result") == "win", dec - 1).when(F.col("result") == "loss", -1.0).when(F.col("result") == "push", 0.0))


def best_board(quotes: DataFrame) -> DataFrame:
    """Per player and market the quote with the largest over probability (then the larger line), its rank on the board and the others' count."""
    best = priced(quotes).where("no_vig_over is not null").groupBy("player_id", "market_key").agg(
        F.max_by(F.struct("snapshot_id", "no_vig_over", "line_value"), F.struct("no_vig_over", "line_value", "snapshot_id")).alias("b"), F.count_distinct("line_value").alias("lines"), F.count(F.lit(1)).alias("quotes"))
    return best.select("player_id", "market_key", "b.snapshot_id", "b.no_vig_over", "b.line_value", "lines", "quotes")
