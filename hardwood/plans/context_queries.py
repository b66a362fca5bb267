"""Context joins, upserts and set comparisons over the role views."""

from pyspark.sql import functions as F

from hardwood.operators import context as C
from hardwood.sources.roles import game_logs, quotes, sql, table

from .registry import query


@query("opponent_disruption", sql("game_logs", """p AS (SELECT team_id, game_date, AVG(CASE WHEN starter THEN 0.0 ELSE 1.0 END) AS v FROM game_logs GROUP BY ALL)
SELECT g.player_id, g.game_id, COALESCE(p.v, 0.0) AS opponent_instability FROM game_logs g LEFT JOIN p ON p.team_id = g.opponent_team_id AND p.game_date = g.game_date"""))
def opponent_disruption(spark, sf):
    return C.opponent_disruption(game_logs(spark, sf))


@query("likely_matchup", sql("game_logs", """r AS (SELECT g.player_id, g.game_id, o.player_id AS m, ROW_NUMBER() OVER (PARTITION BY g.player_id, g.game_id ORDER BY (o.position = g.position) DESC, o.starter DESC, o.minutes DESC, o.player_id) AS k
  FROM game_logs g LEFT JOIN game_logs o ON o.team_id = g.opponent_team_id AND o.game_date = g.game_date)
SELECT player_id, game_id, m AS matchup_player_id FROM r WHERE k = 1"""))
def likely_matchup(spark, sf):
    return C.likely_matchup(game_logs(spark, sf))


@query("travel_km", sql("game_logs", """v AS (SELECT DISTINCT team_id, game_id, game_date, start_time, CASE WHEN is_home THEN team_id ELSE opponent_team_id END AS v FROM game_logs),
s AS (SELECT *, CAST(25 + v * 7 % 24 AS DOUBLE) AS lat, CAST(-120 + v * 11 % 45 AS DOUBLE) AS lon FROM v),
l AS (SELECT *, LAG(lat) OVER w AS lat0, LAG(lon) OVER w AS lon0, COALESCE(date_diff('day', LAG(game_date) OVER w, game_date) <= 1, false) AS b2b FROM s WINDOW w AS (PARTITION BY team_id ORDER BY game_date, start_time, game_id)),
a AS (SELECT *, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2) AS h FROM l),
k AS (SELECT team_id, game_id, b2b, COALESCE(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 0.0) AS travel_km FROM a)
SELECT team_id, game_id, travel_km, CASE WHEN b2b THEN ln(1 + travel_km / 1000) ELSE 0.0 END AS fatigue, travel_km > 2000 AS long_haul FROM k"""))
def travel_km(spark, sf):
    return C.travel(game_logs(spark, sf))


@query("post_hoc_absences", sql("game_logs", """d AS (SELECT DISTINCT team_id, game_date AS day FROM game_logs),
s AS (SELECT d.team_id, d.day, g.player_id, AVG(g.minutes) AS baseline, MAX(g.game_date) AS last_seen FROM d JOIN game_logs g ON g.team_id = d.team_id AND g.game_date < d.day AND g.game_date >= d.day - 21 GROUP BY ALL HAVING AVG(g.minutes) >= 12)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM game_logs g WHERE g.team_id = s.team_id AND g.player_id = s.player_id AND g.game_date = s.day)"""))
def post_hoc_absences(spark, sf):
    return C.post_hoc_absences(game_logs(spark, sf))


@query("orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("shadow_compare", sql("quotes", """a AS (SELECT player_id, market_key, sportsbook_id, AVG(line_value) AS v FROM quotes WHERE snapshot_id % 3 <> 0 GROUP BY ALL), b AS (SELECT player_id, market_key, sportsbook_id, AVG(line_value) AS v FROM quotes WHERE snapshot_id % 3 <> 1 GROUP BY ALL)
SELECT COUNT(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NOT NULL) AS overlap, COUNT(*) FILTER (WHERE b.v IS NULL) AS only_first, COUNT(*) FILTER (WHERE a.v IS NULL) AS only_second, AVG(b.v - a.v) AS mean_change, MAX(abs(b.v - a.v)) AS largest_change
FROM a FULL JOIN b USING (player_id, market_key, sportsbook_id)"""))
def shadow_compare(spark, sf):
    keys = ["player_id", "market_key", "sportsbook_id"]
    side = lambda k: quotes(spark, sf).where(f"snapshot_id % 3 <> {k}").groupBy(*keys).agg(F.avg("line_value").alias("v"))
    return C.compare_keys(side(0), side(1), keys, "v")


@query("merge_upsert", sql("quotes", """c AS (SELECT MIN(ts) + (MAX(ts) - MIN(ts)) / 2 AS cut FROM quotes), o AS (SELECT player_id, market_key, arg_max(line_value, ts) AS line_value FROM quotes, c WHERE ts <= cut GROUP BY ALL), n AS (SELECT player_id, market_key, arg_max(line_value, ts) AS line_value FROM quotes, c WHERE ts > cut GROUP BY ALL)
SELECT player_id, market_key, COALESCE(n.line_value, o.line_value) AS line_value FROM o FULL JOIN n USING (player_id, market_key)"""))
def merge_upsert(spark, sf):
    q = quotes(spark, sf)
    cut = q.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("cut"))
    q = q.crossJoin(F.broadcast(cut))
    old = q.where("ts <= cut").groupBy("player_id", "market_key").agg(F.max_by("line_value", "ts").alias("line_value"))
    return C.upsert(old, q.where("ts > cut").select("player_id", "market_key", "line_value", F.col("ts").alias("seq")), ["player_id", "market_key"])


@query("board_date", sql("quotes", """d AS (SELECT DISTINCT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS d FROM quotes), p AS (SELECT CAST(timezone('America/New_York', timezone('UTC', MIN(ts) + INTERVAL 30 DAY)) AS DATE) AS want FROM quotes)
SELECT COALESCE(MAX(CASE WHEN d = want THEN d END), MIN(CASE WHEN d > want THEN d END), MAX(d)) AS board_date, COUNT(*) AS n_dates FROM d, p"""))
def board_date(spark, sf):
    q = quotes(spark, sf)
    local = lambda c: F.to_date(F.from_utc_timestamp(c.cast("timestamp"), "America/New_York"))
    want = q.agg(local(F.min("ts") + F.expr("interval 30 days")).alias("want"))
    d = q.select(local(F.col("ts")).alias("d")).distinct().crossJoin(F.broadcast(want))
    return d.agg(F.coalesce(F.max(F.when(F.col("d") == F.col("want"), F.col("d"))), F.min(F.when(F.col("d") > F.col("want"), F.col("d"))), F.max("d")).alias("board_date"), F.count(F.lit(1)).alias("n_dates"))


@query("payload_dedupe", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) DESC, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def payload_dedupe(spark, sf):
    score = F.struct(F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0), F.col("o_totalprice"), -F.col("o_orderkey"))
    best = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), score).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", "b.o_totalprice")
