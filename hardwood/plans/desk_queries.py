"""Orders against limits, pick states, slips, insights, parlay prices and adjusted rates over the role views."""

from pyspark.sql import functions as F

from hardwood.operators import desk
from hardwood.operators import windows as W
from hardwood.sources.roles import box_scores, quotes, sql, table
from hardwood.streaming import risk

from .registry import query, round_sql, rounded
from .window_queries import PW

LIMITS = risk.Limits(per_order=40.0, per_market=400.0, cooldown=48 * 3600.0)


def orders(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("market"), F.col("event_id").alias("order_id"), "ts", F.when(F.col("event_id") % 29 > 0, F.col("value")).otherwise(0.0).alias("stake"))


@query("risk_decisions", round_sql("""WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS market, event_id AS order_id, ts, CASE WHEN event_id % 29 > 0 THEN value ELSE 0.0::DOUBLE END AS stake, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT market, 0::BIGINT AS n, 0.0::DOUBLE AS exposure, TIMESTAMP '1900-01-01' AS until, NULL::BIGINT AS order_id, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS stake, NULL::VARCHAR AS reason FROM (SELECT DISTINCT market FROM o)
 UNION ALL SELECT x.market, x.n, CASE WHEN x.reason = 'accepted' THEN x.exposure + x.stake ELSE x.exposure END, CASE WHEN x.reason IN ('accepted', 'cooldown') THEN x.until ELSE x.ts + INTERVAL 48 HOUR END, x.order_id, x.ts, x.stake, x.reason
  FROM (SELECT o.market, o.n, f.exposure, f.until, o.order_id, o.ts, o.stake, CASE WHEN o.ts < f.until THEN 'cooldown' WHEN NOT o.stake > 0 THEN 'stake' WHEN o.stake > 40 THEN 'per order' WHEN f.exposure + o.stake > 400 THEN 'per market' ELSE 'accepted' END AS reason FROM f JOIN o ON o.market = f.market AND o.n = f.n + 1) x)
SELECT market, order_id, ts, stake, reason = 'accepted' AS accepted, reason, exposure FROM f WHERE n > 0""", "stake exposure"))
def risk_decisions(spark, sf):
    return rounded(risk.decisions(orders(spark, sf), LIMITS).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def picks(spark, sf):
    k = F.col("snapshot_id")
    q = quotes(spark, sf)
    gates = F.create_map(*[x for i, g in enumerate(desk.GATES) for x in (F.lit(g), F.when(k % (23 + i) == 1, None).otherwise(k % (17 + i) != 0))])
    mode = F.when(k % 5 == 0, "observe").when(k % 5 == 1, " LIVE ").otherwise("live")
    advice = F.element_at(F.array(*[F.lit(x) for x in ("buy_yes", "Over", "hold", "", "buy_no", "under")]), (k % 6 + 1).cast("int"))
    p, stake = F.pmod(k * 37, F.lit(97)) / 100.0, F.col("line_value") * 0.25
    ask = F.when(k % 4 > 0, (k % 90 + 5) / 100.0)
    state = desk.pick_state(mode, gates, k % 31 != 0, advice, k % 8 != 3, p, (k * 7 % 900).cast("int"), 0.2, 60)
    d = q.select("snapshot_id", "sportsbook_id", "game_id", state.alias("s"), stake.alias("stake"), desk.estimated_profit(p, stake, ask, F.when(k % 3 > 0, p * 0.9)).alias("profit"))
    return d.select("snapshot_id", "sportsbook_id", "game_id", "s.state", "s.reason", "stake", "profit")


def _picks_sql() -> str:
    gate = lambda i: f"(CASE WHEN snapshot_id % {23 + i} = 1 THEN NULL ELSE snapshot_id % {17 + i} <> 0 END)"
    failed = "COALESCE(" + ", ".join(f"CASE WHEN NOT COALESCE({gate(i)}, false) THEN '{g}' END" for i, g in enumerate(desk.GATES)) + ")"
    return f"""a AS (SELECT *, snapshot_id % 5 <> 0 AS live, {failed} AS failed, lower((['buy_yes', 'Over', 'hold', '', 'buy_no', 'under'])[snapshot_id % 6 + 1]) AS advice, (snapshot_id * 37 % 97) / 100.0::DOUBLE AS p, snapshot_id * 7 % 900 AS edge, line_value * 0.25::DOUBLE AS stake,
  CASE WHEN snapshot_id % 4 > 0 THEN (snapshot_id % 90 + 5) / 100.0::DOUBLE END AS ask FROM quotes),
b AS (SELECT *, CASE WHEN NOT live THEN 'observe only' WHEN snapshot_id % 31 = 0 THEN 'no live submit' WHEN advice NOT IN ('buy_yes', 'buy_no', 'over', 'under') THEN 'not executable: ' || CASE WHEN advice = '' THEN 'missing' ELSE advice END END AS barred,
  COALESCE(ask, CASE WHEN snapshot_id % 3 > 0 AND p > 0 THEN p * 0.9::DOUBLE END, 0.5::DOUBLE) AS entry FROM a),
pk AS (SELECT snapshot_id, sportsbook_id, game_id, CASE WHEN live AND failed IS NOT NULL THEN 'blocked' WHEN barred IS NOT NULL OR snapshot_id % 8 = 3 OR p < 0.2 OR edge < 60 THEN 'excluded' ELSE 'queued' END AS state, CASE WHEN live AND failed IS NOT NULL THEN failed ELSE barred END AS reason,
  stake, CASE WHEN stake <= 0 THEN 0 ELSE p * (stake * greatest(1 - entry, 0) / greatest(1 - greatest(1 - entry, 0), 0.01::DOUBLE)) - (1 - p) * stake END AS profit FROM b)"""


@query("pick_states", round_sql(sql("quotes", _picks_sql() + " SELECT * FROM pk"), "stake profit"))
def pick_states(spark, sf):
    return rounded(picks(spark, sf))


@query("bet_slips", sql("quotes", _picks_sql() + """ SELECT sportsbook_id, game_id, COUNT(*) FILTER (WHERE state = 'queued') AS queued, COUNT(*) FILTER (WHERE state = 'excluded') AS excluded, COUNT(*) FILTER (WHERE state = 'blocked') AS blocked,
 round(COALESCE(SUM(stake) FILTER (WHERE state = 'queued'), 0), 4) AS total_stake, round(COALESCE(SUM(profit) FILTER (WHERE state = 'queued'), 0), 4) AS total_profit, round(greatest(2000.0 - round(COALESCE(SUM(stake) FILTER (WHERE state = 'queued'), 0), 4), 0), 4) AS unused FROM pk GROUP BY ALL"""))
def bet_slips(spark, sf):
    return desk.slip(picks(spark, sf), ["sportsbook_id", "game_id"], 2000.0)


@query("prop_insights", round_sql(sql("quotes", """z AS (SELECT MAX(ts) AS now FROM quotes), o AS (SELECT snapshot_id AS quote_id, player_id, market_key AS market, over_odds AS odds, line_value AS line, epoch_us(now - ts) / 1e6::DOUBLE AS age, (snapshot_id * 37 % 90 + 5) / 100.0::DOUBLE AS p, (snapshot_id % 10) / 10.0::DOUBLE AS conf,
  CASE WHEN snapshot_id % 9 > 0 THEN (snapshot_id % 13) / 10.0::DOUBLE END AS unc, CASE WHEN snapshot_id % 6 = 0 THEN snapshot_id % 15 END AS sev, snapshot_id % 7 = 0 AS alt, CASE WHEN snapshot_id % 5 = 0 THEN 0.8::DOUBLE END AS mul FROM quotes, z WHERE over_odds IS NOT NULL),
e AS (SELECT *, p * CASE WHEN odds > 0 THEN odds / 100.0::DOUBLE ELSE 100.0::DOUBLE / -odds END - (1 - p) AS profit, p - CASE WHEN odds > 0 THEN 100.0::DOUBLE / (odds + 100) ELSE -odds / (100.0::DOUBLE - odds) END AS edge FROM o),
g AS (SELECT player_id, market, quantile_cont(line, 0.5) AS mid, MAX(line) - MIN(line) AS width, COUNT(*) AS n, MIN(age) AS newest FROM e GROUP BY ALL),
b AS (SELECT e.*, width, n, newest FROM e JOIN g ON g.player_id = e.player_id AND g.market = e.market QUALIFY ROW_NUMBER() OVER (PARTITION BY e.player_id, e.market ORDER BY profit DESC, edge DESC, p DESC, abs(line - mid), quote_id) = 1),
s AS (SELECT *, least(floor(p * 55), 55) + least(floor(greatest(edge, 0) * 300), 20) + least(n * 4, 12) + least(floor(greatest(conf, 0) * 12), 12) + CASE WHEN newest < 86400 THEN 8 WHEN newest >= 86400 THEN 4 ELSE 0 END + CASE WHEN unc <= 0.35 THEN 10 WHEN unc <= 0.6 THEN 5 ELSE 0 END - COALESCE(sev, 0) - CASE WHEN alt THEN 2 ELSE 0 END AS raw FROM b),
c AS (SELECT *, CAST(greatest(1, least(CASE WHEN market = 'threes' THEN least(trunc(raw * COALESCE(mul, 1)), 71) ELSE trunc(raw * COALESCE(mul, 1)) END, 99)) AS INTEGER) AS confidence FROM s)
SELECT player_id, market, quote_id, CAST(odds AS DOUBLE) AS odds, profit AS expected_profit, edge, CAST(CASE WHEN p >= 0.5 THEN round_even(-100 * p / (1 - p), 0) ELSE round_even(100 * (1 - p) / p, 0) END AS BIGINT) AS fair_odds, width AS market_width, confidence,
 CASE WHEN confidence >= 85 THEN 'Elite' WHEN confidence >= 72 THEN 'Strong' WHEN confidence >= 60 THEN 'Solid' WHEN confidence >= 48 THEN 'Watch' ELSE 'Fragile' END AS tier,
 concat_ws('; ', CASE WHEN width >= 1.5 THEN 'wide market' END, CASE WHEN n < 2 THEN 'one book' END, CASE WHEN newest >= 86400 THEN 'old quote' END, CASE WHEN unc > 0.6 THEN 'uncertain' END, CASE WHEN sev >= 10 THEN 'injury' END, CASE WHEN edge < 0 THEN 'no edge' END) AS warnings FROM c"""), "odds expected_profit edge market_width"))
def prop_insights(spark, sf):
    k = F.col("snapshot_id")
    now = quotes(spark, sf).agg(F.max("ts").alias("now"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    q = quotes(spark, sf).where("over_odds is not null").crossJoin(F.broadcast(now)).select(
        k.alias("quote_id"), "player_id", F.col("market_key").alias("market"), F.col("over_odds").cast("double").alias("odds"), F.col("line_value").alias("line"), ((micros("now") - micros("ts")) / 1e6).alias("age"), ((k * 37 % 90 + 5) / 100.0).alias("p"),
        (k % 10 / 10.0).alias("data_confidence"), F.when(k % 9 > 0, k % 13 / 10.0).alias("uncertainty"), F.when(k % 6 == 0, (k % 15).cast("int")).alias("severity"), (k % 7 == 0).alias("alternate"), F.when(k % 5 == 0, 0.8).alias("multiplier"))
    return rounded(desk.prop_insights(q.withColumn("key", F.col("market")), ["player_id", "key"]).withColumnRenamed("key", "market"))


@query("parlay_prices", round_sql(sql("quotes", """l AS (SELECT snapshot_id // 4 AS parlay_id, player_id, CASE WHEN snapshot_id // 4 % 3 = 0 THEN 1 ELSE game_id END AS game_id, market_key AS market, over_odds * CASE WHEN snapshot_id % 13 = 0 THEN 5 ELSE 1 END AS odds FROM quotes WHERE over_odds IS NOT NULL),
i AS (SELECT *, CASE WHEN odds > 0 THEN 100.0::DOUBLE / (odds + 100) ELSE -odds / (100.0::DOUBLE - odds) END AS p, CASE WHEN odds > 0 THEN 1 + odds / 100.0::DOUBLE ELSE 1 - 100.0::DOUBLE / odds END AS d FROM l),
g AS (SELECT parlay_id, COUNT(*) AS legs, COUNT(DISTINCT game_id) AS games, COUNT(*) - COUNT(DISTINCT player_id) AS sp, COUNT(*) - COUNT(DISTINCT market) AS sm, AVG(p) AS mp, COUNT(*) FILTER (WHERE p < 0.18) AS tail, COUNT(*) FILTER (WHERE p < 0.10) AS ext, product(d) AS raw FROM i GROUP BY parlay_id),
c AS (SELECT *, CASE WHEN games = 1 THEN pow(0.34, legs - 1) / pow(greatest(1 + 0.12::DOUBLE * (legs - games) + 0.08::DOUBLE * sp, 1), 1.15) * pow(0.78, sp) * pow(0.86, sm) * least(greatest(pow(mp / 0.30, 0.40), 0.42), 1.0) * pow(0.82, tail) * pow(0.72, ext)
  ELSE pow(0.97, legs - 1) * pow(0.94, sp) * least(greatest(pow(mp / 0.28, 0.18), 0.72), 1.0) * pow(0.90, tail) END AS m FROM g)
SELECT parlay_id, legs, games, raw AS raw_odds, CASE WHEN raw <= 1 THEN greatest(raw, 1.01) ELSE 1 + (raw - 1) * least(greatest(m, 0.015), 1.0) END AS priced_odds FROM c"""), "raw_odds priced_odds"))
def parlay_prices(spark, sf):
    k = F.col("snapshot_id")
    parlay = F.expr("snapshot_id div 4")
    legs = quotes(spark, sf).where("over_odds is not null").select(parlay.alias("parlay_id"), "player_id", F.when(parlay % 3 == 0, 1).otherwise(F.col("game_id")).alias("game_id"), F.col("market_key").alias("market"), (F.col("over_odds") * F.when(k % 13 == 0, 5).otherwise(1)).alias("odds"))
    return rounded(desk.parlay_prices(legs, 1 + 0.12 * (F.col("legs") - F.col("games")) + 0.08 * F.col("same_player")))


@query("adjusted_rates", round_sql(sql("box_scores", f"""r AS (SELECT player_id, game_id, AVG(minutes) OVER a AS bm, AVG(minutes) OVER b AS am, AVG(CAST(field_goal_attempts AS DOUBLE)) OVER a AS bu, AVG(CAST(field_goal_attempts AS DOUBLE)) OVER b AS au, field_goal_attempts / NULLIF(minutes, 0) AS fga, rebounds / NULLIF(minutes, 0) AS reb
  FROM box_scores WINDOW a AS ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS ({PW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT player_id, game_id, COALESCE(fga, 0) * least(greatest(COALESCE(au, bu, 0) / greatest(COALESCE(bu, 0), 1e-6), 0), 2) AS adjusted_fga, COALESCE(reb, 0) * least(greatest(COALESCE(am, bm, 0) / greatest(COALESCE(bm, 0), 1e-6), 0), 2) AS adjusted_reb FROM r"""), "adjusted_fga adjusted_reb"))
def adjusted_rates(spark, sf):
    w = W.by("player_id")
    mean = lambda c, n: F.avg(F.col(c).cast("double")).over(W.before(w, n))
    d = box_scores(spark, sf).select("player_id", "game_id", mean("minutes", None).alias("baseline_minutes"), mean("minutes", 3).alias("adjusted_minutes"), mean("field_goal_attempts", None).alias("baseline_usage"), mean("field_goal_attempts", 3).alias("adjusted_usage"),
                                     F.try_divide(F.col("field_goal_attempts").cast("double"), "minutes").alias("fga"), F.try_divide(F.col("rebounds").cast("double"), "minutes").alias("reb"))
    return rounded(desk.adjusted_rates(d, ["fga"], ["reb"]).select("player_id", "game_id", "adjusted_fga", "adjusted_reb"))


@query("stabilised_threes", round_sql(sql("game_logs", f"""r AS (SELECT player_id, game_id, COALESCE(AVG(CAST(threes AS DOUBLE)) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS mean, COALESCE(AVG(CAST(threes AS DOUBLE)) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS a5, COALESCE(AVG(CAST(threes AS DOUBLE)) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS a10,
  COALESCE(AVG(CAST(threes AS DOUBLE)) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS a20, COALESCE(AVG(CAST(threes AS DOUBLE)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, COALESCE(STDDEV_SAMP(CAST(threes AS DOUBLE)) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS sd, COALESCE(AVG(minutes) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) / 8 AS pm FROM game_logs WINDOW w AS ({PW})),
t AS (SELECT *, greatest(0.40::DOUBLE * a5 + 0.25::DOUBLE * a10 + 0.20::DOUBLE * a20 + 0.15::DOUBLE * s, 0) AS anchor FROM r), u AS (SELECT *, greatest(anchor, s, a10, s) AS top FROM t),
v AS (SELECT *, greatest(top + 1.15::DOUBLE * greatest(sd, 0.55), a5 + 0.90::DOUBLE, a10 + 1.10::DOUBLE, s + 1.35::DOUBLE, greatest(pm * greatest(0.1::DOUBLE, 0.06) * 0.44::DOUBLE, 0.70)) AS ceil FROM u)
SELECT player_id, game_id, least(greatest(0.5::DOUBLE * mean + 0.5::DOUBLE * top, 0), greatest(top + 0.35::DOUBLE, least(ceil, top * 1.28::DOUBLE))) AS stable_mean FROM v"""), "stable_mean"))
def stabilised_threes(spark, sf):
    from hardwood.sources.roles import game_logs

    w = W.by("player_id")
    mean = lambda c, n: F.coalesce(F.avg(F.col(c).cast("double")).over(W.before(w, n)), F.lit(0.0))
    d = game_logs(spark, sf).select("player_id", "game_id", mean("threes", 2).alias("mean"), mean("threes", 5).alias("avg_5"), mean("threes", 10).alias("avg_10"), mean("threes", 20).alias("avg_20"), mean("threes", None).alias("season"), mean("threes", None).alias("baseline"),
                                    F.coalesce(F.stddev_samp(F.col("threes").cast("double")).over(W.before(w, 10)), F.lit(0.0)).alias("std_10"), (mean("minutes", 10) / 8).alias("predicted_minutes"), F.lit(0.1).alias("attempt_rate"))
    return rounded(desk.stabilised_threes(d).select("player_id", "game_id", "stable_mean"))
