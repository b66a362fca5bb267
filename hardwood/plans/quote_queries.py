"""Quote queries over the role views."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hardwood.functions import odds as O
from hardwood.operators import quotes as Q
from hardwood.sources.roles import quotes, sql

from .registry import query

IMP = lambda c: f"CASE WHEN {c} > 0 THEN 100.0::DOUBLE / ({c} + 100) WHEN {c} < 0 THEN CAST(-{c} AS DOUBLE) / (100 - {c}) END"
DEC = lambda c: f"CASE WHEN {c} > 0 THEN 1 + CAST({c} AS DOUBLE) / 100 WHEN {c} < 0 THEN 1 - 100.0::DOUBLE / {c} ELSE 1.0::DOUBLE END"
PRICED = f"""i AS (SELECT *, {IMP('over_odds')} AS over_p, {IMP('under_odds')} AS under_p FROM quotes),
c AS (SELECT *, (over_p + under_p - 1) / 2 AS cut FROM i),
priced AS (SELECT *, over_p / (over_p + under_p) AS no_vig_over,
  CASE WHEN over_p IS NULL OR under_p IS NULL THEN NULL WHEN greatest(over_p - cut, 0) + greatest(under_p - cut, 0) <= 0 THEN 0.5 ELSE greatest(over_p - cut, 0) / (greatest(over_p - cut, 0) + greatest(under_p - cut, 0)) END AS additive_over FROM c)"""
REP = PRICED + """, mid AS (SELECT player_id, market_key, quantile_cont(line_value, 0.5) AS median_line FROM quotes GROUP BY ALL),
rep AS (SELECT p.* FROM priced p JOIN mid USING (player_id, market_key)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, market_key, sportsbook_id ORDER BY COALESCE(abs(no_vig_over - 0.5), 1.0), abs(line_value - median_line), ts DESC, snapshot_id DESC) = 1),
consensus AS (SELECT player_id, market_key, quantile_cont(line_value, 0.5) AS line_median, AVG(line_value) AS line_mean, STDDEV_POP(line_value) AS line_std, AVG(no_vig_over) AS no_vig_mean, STDDEV_POP(no_vig_over) AS no_vig_std,
  MAX(over_odds) AS best_over, MAX(under_odds) AS best_under, COUNT(DISTINCT sportsbook_id) AS books, COUNT(*) AS quotes, arg_max(snapshot_id, ts) AS base_snapshot FROM rep GROUP BY player_id, market_key)"""


@query("no_vig_quotes", sql("quotes", PRICED + f" SELECT snapshot_id, over_p, under_p, no_vig_over, additive_over, {DEC('over_odds')} AS over_decimal FROM priced"))
def no_vig_quotes(spark, sf):
    return Q.priced(quotes(spark, sf)).select("snapshot_id", "over_p", "under_p", "no_vig_over", "additive_over", O.decimal_odds(F.col("over_odds")).alias("over_decimal"))


@query("latest_per_book", sql("quotes", "SELECT player_id, market_key, sportsbook_id, snapshot_id, ts, line_value FROM quotes QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, market_key, sportsbook_id ORDER BY ts DESC, snapshot_id DESC) = 1"))
def latest_per_book(spark, sf):
    return Q.latest(quotes(spark, sf), "player_id", "market_key", "sportsbook_id").select("player_id", "market_key", "sportsbook_id", "snapshot_id", "ts", "line_value")


@query("consensus_odds", sql("quotes", REP + " SELECT * FROM consensus"))
def consensus_odds(spark, sf):
    return Q.consensus(Q.representative(quotes(spark, sf)))


@query("line_movement", sql("quotes", "n AS (SELECT *, MAX(ts) OVER (PARTITION BY player_id, market_key) AS now FROM quotes), b AS (SELECT player_id, market_key, sportsbook_id, arg_max(line_value, ts) AS l0"
       + "".join(f", arg_max(line_value, ts) FILTER (WHERE ts <= now - INTERVAL {h} HOUR) AS l{h}" for h in (1, 6, 24)) + " FROM n GROUP BY ALL) SELECT player_id, market_key"
       + "".join(f", COALESCE(quantile_cont(l0, 0.5) - quantile_cont(l{h}, 0.5), 0.0) AS move_{h}h" for h in (1, 6, 24)) + " FROM b GROUP BY player_id, market_key"))
def line_movement(spark, sf):
    return Q.line_movement(quotes(spark, sf))


@query("point_in_time_quotes", sql("quotes", """s AS (SELECT *, MAX(ts) OVER (PARTITION BY game_id) AS start FROM quotes)
SELECT game_id, player_id, market_key, COALESCE(arg_max(snapshot_id, ts) FILTER (WHERE ts <= start - INTERVAL 90 MINUTE), arg_max(snapshot_id, ts) FILTER (WHERE ts <= start)) AS snapshot_id,
 arg_max(line_value, ts) AS closing_line FROM s GROUP BY game_id, player_id, market_key"""))
def point_in_time_quotes(spark, sf):
    q = quotes(spark, sf)
    start = q.groupBy("game_id").agg(F.max("ts").alias("start"))
    keys = ["game_id", "player_id", "market_key"]
    rows = q.select(*keys, "snapshot_id", "ts").join(start, "game_id")
    picked = Q.as_of(rows, keys, F.col("ts"), F.col("start") - F.expr("interval 90 minutes"), F.col("start")).select(*keys, "snapshot_id")
    close = q.groupBy(*keys).agg(F.max_by("line_value", F.struct("ts", "snapshot_id")).alias("closing_line"))
    return picked.join(close, keys, "left")


@query("closing_lines", sql("quotes", "SELECT game_id, sportsbook_id, player_id, market_key, line_value, over_odds, under_odds, ts AS captured_at FROM quotes QUALIFY ROW_NUMBER() OVER (PARTITION BY game_id, sportsbook_id, player_id, market_key ORDER BY ts DESC) = 1"))
def closing_lines(spark, sf):
    return Q.closing_lines(quotes(spark, sf))


@query("training_quote_flags", sql("quotes", """m AS (SELECT *, MIN(ts) OVER () + to_days(CAST(TRY_CAST(json_extract_string(meta, '$.k') AS INTEGER) // 3 AS INTEGER)) AS event_start FROM quotes),
e AS (SELECT *, CASE WHEN snapshot_id % 6 <> 0 AND game_id <> 3 THEN event_start END AS es FROM m), s AS (SELECT game_id, arg_max(es, ts) FILTER (WHERE es IS NOT NULL) AS start FROM e GROUP BY game_id),
o AS (SELECT e.*, s.start IS NULL OR ts < s.start - INTERVAL 5 MINUTE AS ok FROM e LEFT JOIN s USING (game_id))
SELECT snapshot_id, ok AND ROW_NUMBER() OVER (PARTITION BY game_id, sportsbook_id, player_id, market_key ORDER BY ok DESC, ts DESC, snapshot_id DESC) = 1 AS is_training_quote FROM o"""))
def training_quote_flags(spark, sf):
    q = quotes(spark, sf)
    first = q.agg(F.min("ts").alias("first"))
    days = F.floor(F.get_json_object("meta", "$.k").try_cast("int") / 3).cast("int")
    start = F.when((F.col("snapshot_id") % 6 != 0) & (F.col("game_id") != 3), F.col("first") + F.make_dt_interval(days=days))
    return Q.training_flags(q.crossJoin(F.broadcast(first)).withColumn("event_start", start).drop("first"))


MARKETS = ("click", "error", "purchase", "signup", "view")


@query("odds_pivot_wide", sql("quotes", REP + " SELECT player_id" + "".join(
    f", MAX(line_median) FILTER (WHERE market_key = '{m}') AS {m}_line, MAX(no_vig_mean) FILTER (WHERE market_key = '{m}') AS {m}_p, MAX(books) FILTER (WHERE market_key = '{m}') AS {m}_books" for m in MARKETS) + " FROM consensus GROUP BY player_id"))
def odds_pivot_wide(spark, sf):
    return Q.odds_wide(quotes(spark, sf), MARKETS)


BETS = PRICED + f""", a AS (SELECT *, LEAD(line_value) OVER (PARTITION BY player_id, market_key ORDER BY ts) AS actual, 0.3 + (snapshot_id % 41) / 100.0 AS p, {DEC('over_odds')} AS od, {DEC('under_odds')} AS ud FROM priced),
s AS (SELECT *, CASE WHEN over_odds IS NULL AND under_odds IS NULL THEN NULL WHEN under_odds IS NULL OR (over_odds IS NOT NULL AND p >= 0.5) THEN 'OVER' ELSE 'UNDER' END AS side FROM a),
r AS (SELECT *, CASE WHEN side IS NULL OR actual IS NULL THEN NULL WHEN abs(actual - line_value) <= 1e-8 + 1e-5 * abs(line_value) THEN 'push' WHEN (side = 'OVER') = (actual > line_value) THEN 'win' ELSE 'loss' END AS result,
  CASE WHEN side = 'OVER' THEN p * (od - 1) - (1 - p) ELSE (1 - p) * (ud - 1) - p END AS ev FROM s),
bets AS (SELECT *, p - no_vig_over AS over_edge, CASE result WHEN 'win' THEN CASE WHEN side = 'OVER' THEN od ELSE ud END - 1 WHEN 'loss' THEN -1.0 WHEN 'push' THEN 0.0 END AS profit FROM r)"""


def bets(spark, sf):
    q = quotes(spark, sf)
    q = q.withColumn("next", F.lead("line_value").over(Window.partitionBy("player_id", "market_key").orderBy("ts")))
    return Q.finalize_bets(q, 0.3 + (F.col("snapshot_id") % 41) / 100.0, F.col("next"))


@query("finalized_bets", sql("quotes", BETS + " SELECT snapshot_id, side, over_edge, ev, result, profit FROM bets"))
def finalized_bets(spark, sf):
    return bets(spark, sf).select("snapshot_id", "side", "over_edge", "ev", "result", "profit")


SEG = "COUNT(*) AS quotes, COUNT(profit) AS bets, COUNT(*) FILTER (WHERE result = 'win') AS wins, COUNT(*) FILTER (WHERE result = 'push') AS pushes, COALESCE(SUM(profit), 0.0) AS profit, CASE WHEN COUNT(profit) = 0 THEN AVG(ev) ELSE AVG(ev) FILTER (WHERE profit IS NOT NULL) END AS mean_ev, SUM(profit) / NULLIF(COUNT(profit), 0) AS roi"


@query("betting_summary_segments", sql("quotes", BETS + f""" SELECT CASE WHEN GROUPING(market_key) = 0 THEN 'market' WHEN GROUPING(sportsbook_id) = 0 THEN 'sportsbook' ELSE 'overall' END AS segment,
 COALESCE(market_key, CAST(sportsbook_id AS VARCHAR), 'all') AS value, {SEG} FROM bets GROUP BY GROUPING SETS ((), (market_key), (sportsbook_id))"""))
def betting_summary_segments(spark, sf):
    bets(spark, sf).createOrReplaceTempView("hardwood_bets")
    return spark.sql("""SELECT CASE WHEN grouping(market_key) = 0 THEN 'market' WHEN grouping(sportsbook_id) = 0 THEN 'sportsbook' ELSE 'overall' END AS segment,
      coalesce(market_key, cast(sportsbook_id AS string), 'all') AS value, count(*) AS quotes, count(profit) AS bets, count_if(result = 'win') AS wins, count_if(result = 'push') AS pushes,
      coalesce(sum(profit), 0.0D) AS profit, CASE WHEN count(profit) = 0 THEN avg(ev) ELSE avg(ev) FILTER (WHERE profit IS NOT NULL) END AS mean_ev, try_divide(sum(profit), count(profit)) AS roi
      FROM hardwood_bets GROUP BY GROUPING SETS ((), (market_key), (sportsbook_id))""")


@query("best_quote_board", sql("quotes", PRICED + """ SELECT player_id, market_key, arg_max(snapshot_id, {'p': no_vig_over, 'l': line_value, 's': snapshot_id}) AS snapshot_id, MAX(no_vig_over) AS no_vig_over,
 arg_max(line_value, {'p': no_vig_over, 'l': line_value, 's': snapshot_id}) AS line_value, COUNT(DISTINCT line_value) AS lines, COUNT(*) AS quotes FROM priced WHERE no_vig_over IS NOT NULL GROUP BY player_id, market_key"""))
def best_quote_board(spark, sf):
    return Q.best_board(quotes(spark, sf))
