"""Pricing, bias, stabilised probabilities and confidence over the role views."""

from pyspark.sql import functions as F

from hardwood.functions import odds as O
from hardwood.operators import pricing as P
from hardwood.operators import quotes as Q
from hardwood.sources.roles import game_logs, predictions, quotes, sql

from .quote_queries import DEC, IMP, PRICED, bets, BETS
from .registry import query

DEC2 = lambda c: f"COALESCE({DEC(c)}, 2.0)".replace("ELSE 1.0::DOUBLE", "ELSE 2.0::DOUBLE")


def modelled(spark, sf):
    """Quotes with a model's over and under probabilities."""
    k = F.col("snapshot_id")
    return quotes(spark, sf).withColumns({"mo": (k * 13 % 89 + 5) / 100.0, "mu": (k * 7 % 83 + 3) / 100.0})


MODELLED = "modelled AS (SELECT *, (snapshot_id * 13 % 89 + 5) / 100.0::DOUBLE AS mo, (snapshot_id * 7 % 83 + 3) / 100.0::DOUBLE AS mu FROM quotes)"


def _price_sql(over: str, under: str) -> str:
    return f"""s AS (SELECT *, CASE WHEN over_odds IS NOT NULL AND (under_odds IS NULL OR {over} >= {under}) THEN 'OVER' WHEN under_odds IS NOT NULL THEN 'UNDER' ELSE 'OVER' END AS side,
  COALESCE({IMP('over_odds')}, 0.5) AS o, COALESCE({IMP('under_odds')}, 0.5) AS u FROM x),
h AS (SELECT *, CASE side WHEN 'OVER' THEN {over} ELSE {under} END AS hit, CASE side WHEN 'OVER' THEN o ELSE u END AS market, CASE side WHEN 'OVER' THEN {DEC2('over_odds')} ELSE {DEC2('under_odds')} END AS d,
  CASE WHEN over_odds IS NOT NULL AND under_odds IS NOT NULL THEN CASE side WHEN 'OVER' THEN o ELSE u END / (o + u) ELSE CASE side WHEN 'OVER' THEN o ELSE u END END AS no_vig FROM s),
priced_prop AS (SELECT *, hit * (d - 1) - greatest(0, 1 - hit) AS ev, hit - no_vig AS edge, CASE WHEN hit >= 0.67 THEN 'high' WHEN hit >= 0.60 THEN 'medium' ELSE 'low' END AS confidence FROM h)"""


@query("price_props", sql("quotes", MODELLED + ", x AS (SELECT * FROM modelled), " + _price_sql("mo", "mu") + " SELECT snapshot_id, side, hit, market, no_vig, ev, edge, confidence FROM priced_prop"))
def price_props(spark, sf):
    return modelled(spark, sf).select("snapshot_id", P.price(F.col("mo"), F.col("mu"), F.col("over_odds"), F.col("under_odds")).alias("x")).select("snapshot_id", "x.*")


@query("push_probability", sql("quotes", MODELLED + " SELECT snapshot_id, greatest(0, 1 - mo - mu) AS push, greatest(0, 1 - (mo * 0.9 + 0.05) - greatest(0, 1 - mo - mu)) AS calibrated_under FROM modelled"))
def push_probability(spark, sf):
    m = modelled(spark, sf).withColumn("push", P.push(F.col("mo"), F.col("mu")))
    return m.select("snapshot_id", "push", P.push(F.col("mo") * 0.9 + 0.05, F.col("push")).alias("calibrated_under"))


@query("bias_corrected", sql("quotes", MODELLED + """, g AS (SELECT player_id, market_key, CASE WHEN line_value > 50 THEN 1.0 ELSE 0.0 END AS over FROM quotes),
m AS (SELECT market_key, round(0.5 - AVG(over), 4) AS moff FROM g WHERE market_key <> 'view' GROUP BY 1), p AS (SELECT player_id, round(0.5 - AVG(over), 4) AS poff FROM g WHERE player_id % 3 = 0 GROUP BY 1),
x AS (SELECT q.*, COALESCE(poff, moff, 0.02) AS bias, least(greatest(mo - COALESCE(poff, moff, 0.02), 0.001), 0.999) AS co, least(greatest(mu + COALESCE(poff, moff, 0.02), 0.001), 0.999) AS cu FROM modelled q LEFT JOIN p USING (player_id) LEFT JOIN m USING (market_key)), """
       + _price_sql("co", "cu") + " SELECT snapshot_id, bias::DOUBLE AS bias, side, hit, no_vig FROM priced_prop"))
def bias_corrected(spark, sf):
    q = modelled(spark, sf)
    g = q.select("player_id", "market_key", F.when(F.col("line_value") > 50, 1.0).otherwise(0.0).alias("over"))
    offset = F.round(0.5 - F.avg("over"), 4).alias("offset")
    j = P.with_offsets(q, g.where("player_id % 3 = 0").groupBy("player_id").agg(offset), g.where("market_key <> 'view'").groupBy("market_key").agg(offset), 0.02)
    x = P.price(P.corrected(F.col("mo"), F.col("bias")), P.corrected(F.col("mu"), -F.col("bias")), F.col("over_odds"), F.col("under_odds"))
    return j.select("snapshot_id", "bias", x.alias("x")).select("snapshot_id", "bias", "x.side", "x.hit", "x.no_vig")


@query("stabilised_over", sql("quotes", PRICED + """, x AS (SELECT snapshot_id, no_vig_over, over_p, under_p, least(greatest((snapshot_id * 13 % 101) / 100.0::DOUBLE, 1e-4), 1 - 1e-4) AS c, least(greatest((snapshot_id * 29 % 97) / 97.0::DOUBLE, 1e-4), 1 - 1e-4) AS r FROM priced),
f AS (SELECT *, least(greatest(COALESCE(CASE WHEN no_vig_over > 0 THEN no_vig_over END, CASE WHEN over_p > 0 THEN over_p END, CASE WHEN 1 - under_p > 0 AND 1 - under_p < 1 THEN 1 - under_p END, 0.5), 0.025), 0.975) AS o FROM x),
w AS (SELECT *, least(greatest(0.70 * o + 0.30 * r, 1e-4), 1 - 1e-4) AS t, 0.08 * least(greatest((0.20 - least(o, 1 - o)) / 0.15, 0), 1) AS w1,
  CASE WHEN o BETWEEN 0.15 AND 0.85 AND (c > 0.85 OR c < 0.15) THEN 0.50 * least(greatest((abs(c - o) - 0.20) / 0.30, 0), 1) ELSE 0 END AS w2 FROM f)
SELECT snapshot_id, o::DOUBLE AS offered, least(greatest((1 - greatest(w1, w2)) * c + greatest(w1, w2) * t, 1e-4), 1 - 1e-4)::DOUBLE AS stabilised FROM w"""))
def stabilised_over(spark, sf):
    k = F.col("snapshot_id")
    q = Q.priced(quotes(spark, sf)).withColumn("offered", P.offered_over(F.col("no_vig_over"), F.col("over_p"), F.col("under_p"), F.lit(None).cast("double")))
    return q.select("snapshot_id", "offered", P.stabilised(k * 13 % 101 / 100.0, k * 29 % 97 / 97.0, F.col("offered")).alias("stabilised"))


@query("data_confidence", sql("game_logs", """a AS (SELECT player_id, COUNT(*) AS n, AVG(points) AS mean, VAR_POP(points) AS var FROM game_logs GROUP BY player_id),
t AS (SELECT *, CASE WHEN n >= 12 THEN 'A' WHEN n >= 8 THEN 'B' WHEN n >= 4 THEN 'C' ELSE 'D' END AS tier FROM a)
SELECT player_id, tier, least(greatest(CASE tier WHEN 'A' THEN 0.85 WHEN 'B' THEN 0.65 WHEN 'C' THEN 0.45 ELSE 0.25 END - least(var / (mean + 1.0), 0.30) + least(n / 30.0, 0.10) + CASE WHEN player_id % 6 <= 3 THEN 0.05 ELSE 0 END
  - CASE WHEN player_id % 5 = 0 THEN 0.15 ELSE 0 END - CASE WHEN player_id % 7 = 0 THEN 0.10 ELSE 0 END, 0.05), 0.95)::DOUBLE AS confidence FROM t"""))
def data_confidence(spark, sf):
    a = game_logs(spark, sf).groupBy("player_id").agg(F.count(F.lit(1)).alias("n"), F.avg("points").alias("mean"), F.var_pop("points").alias("var"))
    a = a.withColumn("tier", F.when(F.col("n") >= 12, "A").when(F.col("n") >= 8, "B").when(F.col("n") >= 4, "C").otherwise("D"))
    k = F.col("player_id")
    return a.select("player_id", "tier", P.data_confidence(F.col("tier"), F.col("var"), F.col("mean"), F.col("n"), k % 6, k % 5 == 0, k % 7 == 0).alias("confidence"))


@query("odds_formats", sql("predictions", """d AS (SELECT player_id, game_id, p, 1.0::DOUBLE / least(greatest(p, 1e-6), 1 - 1e-6) AS dec FROM predictions)
SELECT player_id, game_id, dec, CAST(CASE WHEN dec <= 1 THEN NULL WHEN dec < 2 THEN round_even(-100.0::DOUBLE / (dec - 1), 0) ELSE round_even((dec - 1) * 100.0::DOUBLE, 0) END AS BIGINT) AS american,
 CAST(CASE WHEN p >= 0.5 THEN round_even(-100.0::DOUBLE * p / (1 - p), 0) ELSE round_even(100.0::DOUBLE * (1 - p) / p, 0) END AS BIGINT) AS fair, CAST(round_even(least(greatest(p, 0.01), 0.99) * 100, 0) AS BIGINT) AS cents FROM d"""))
def odds_formats(spark, sf):
    p = F.col("p")
    d = predictions(spark, sf).withColumn("dec", 1.0 / O.clip(p, 1e-6, 1 - 1e-6))
    return d.select("player_id", "game_id", "dec", O.american(F.col("dec")).alias("american"), O.fair_american(p).alias("fair"), O.cents(p).alias("cents"))


@query("confidence_buckets", sql("predictions", """SELECT player_id, game_id, CASE WHEN p < 0.55 THEN 'low' WHEN p < 0.70 THEN 'mid' WHEN p < 0.85 THEN 'high' ELSE 'extreme' END AS bucket,
 printf('%.1f', round_even(line / 0.5, 0) * 0.5) AS line_bucket FROM predictions"""))
def confidence_buckets(spark, sf):
    return predictions(spark, sf).select("player_id", "game_id", P.confidence_bucket(F.col("p")).alias("bucket"), P.line_bucket(F.col("line")).alias("line_bucket"))


@query("candidate_viability", sql("quotes", PRICED + f""", cand AS (SELECT *, (snapshot_id % 80 + 10) / 100.0::DOUBLE AS hit, snapshot_id % 4 = 0 AS alt, (snapshot_id % 80 + 10) / 100.0::DOUBLE - over_p AS edge, (snapshot_id % 80 + 10) / 100.0::DOUBLE * {DEC('over_odds')} - 1 AS profit FROM priced WHERE over_odds IS NOT NULL)
SELECT snapshot_id, CASE WHEN hit < 0.24 THEN false WHEN edge <= 0 AND profit <= 0 THEN false WHEN alt AND hit < 0.28 THEN false WHEN alt AND over_odds >= 400 AND hit < 0.31 THEN false WHEN alt AND over_odds >= 800 AND hit < 0.35 THEN false
 WHEN over_odds >= 500 AND profit < 0.06 THEN false WHEN hit >= 0.60 THEN edge > 0.01 WHEN hit >= 0.52 THEN edge > 0.02 AND profit > 0.02 ELSE profit > 0.05 AND edge > 0.03 END AS viable FROM cand"""))
def candidate_viability(spark, sf):
    k = F.col("snapshot_id")
    hit = (k % 80 + 10) / 100.0
    q = Q.priced(quotes(spark, sf)).where("over_odds is not null")
    return q.select("snapshot_id", P.viable(hit, hit - F.col("over_p"), hit * O.decimal_odds(F.col("over_odds")) - 1, F.col("over_odds"), k % 4 == 0).alias("viable"))


@query("executable_quotes", sql("quotes", """b AS (SELECT snapshot_id, CASE WHEN snapshot_id % 2 = 0 THEN 'OVER' ELSE 'UNDER' END AS side, CASE WHEN snapshot_id % 5 > 0 THEN (snapshot_id % 90 + 5) / 100.0::DOUBLE END AS ya,
  CASE WHEN snapshot_id % 7 > 1 THEN (snapshot_id % 85 + 2) / 100.0::DOUBLE END AS yb, CASE WHEN snapshot_id % 3 > 0 THEN (snapshot_id % 95 + 1) / 100.0::DOUBLE END AS na FROM quotes),
n AS (SELECT *, CASE WHEN na IS NULL AND yb IS NOT NULL THEN greatest(0, 1 - yb) ELSE na END AS no, CASE WHEN yb IS NULL AND na IS NOT NULL THEN greatest(0, 1 - na) ELSE yb END AS yes FROM b)
SELECT snapshot_id, CASE WHEN side = 'OVER' AND ya IS NOT NULL THEN 'bid' WHEN side = 'UNDER' AND no IS NOT NULL AND yes IS NOT NULL THEN 'ask' END AS order_side,
  CASE WHEN side = 'OVER' THEN ya WHEN no IS NOT NULL AND yes IS NOT NULL THEN yes END AS order_price, CASE WHEN side = 'OVER' THEN ya WHEN no IS NOT NULL AND yes IS NOT NULL THEN no END AS contract_cost FROM n"""))
def executable_quotes(spark, sf):
    k = F.col("snapshot_id")
    side = F.when(k % 2 == 0, "OVER").otherwise("UNDER")
    ask, bid, no = F.when(k % 5 > 0, (k % 90 + 5) / 100.0), F.when(k % 7 > 1, (k % 85 + 2) / 100.0), F.when(k % 3 > 0, (k % 95 + 1) / 100.0)
    return quotes(spark, sf).select("snapshot_id", P.executable(side, ask, bid, no).alias("x")).select("snapshot_id", "x.order_side", "x.order_price", "x.contract_cost")


@query("threshold_roi", sql("quotes", BETS + " SELECT t::DOUBLE AS threshold, COUNT(*) AS n, COUNT(*) FILTER (WHERE result = 'win')::DOUBLE / NULLIF(COUNT(*) FILTER (WHERE result <> 'push'), 0) AS hit_rate, AVG(profit) AS roi FROM bets, (SELECT unnest([0.0, 0.02, 0.05, 0.1]) AS t) WHERE CASE WHEN side = 'OVER' THEN over_edge ELSE -over_edge END >= t AND profit IS NOT NULL GROUP BY t"))
def threshold_roi(spark, sf):
    """By the edge of the recommended side."""
    cuts = F.array(*[F.lit(t) for t in (0.0, 0.02, 0.05, 0.1)])
    edge = F.when(F.col("side") == "OVER", F.col("over_edge")).otherwise(-F.col("over_edge"))
    b = bets(spark, sf).where("profit is not null").withColumn("edge", edge).select("profit", "result", F.explode(F.filter(cuts, lambda t: F.col("edge") >= t)).alias("threshold"))
    return b.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if(F.col("result") == "win"), F.count_if(F.col("result") != "push")).alias("hit_rate"), F.avg("profit").alias("roi"))


@query("surfacing_filter", sql("predictions", "SELECT player_id, game_id, market, p FROM predictions WHERE lower(market) NOT IN ('threes') AND NOT abs(p - 0.5) > 0.35"))
def surfacing_filter(spark, sf):
    return predictions(spark, sf).where(~F.lower("market").isin("threes") & ~(F.abs(F.col("p") - 0.5) > 0.35)).select("player_id", "game_id", "market", "p")
