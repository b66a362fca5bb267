"""What the application serves: boards, histories, top lists, diagnostics; over the role views."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hardwood.functions import text as X
from hardwood.operators import frames, matching
from hardwood.operators import metrics as M
from hardwood.operators import quotes as Q
from hardwood.operators import windows as W
from hardwood.sources.roles import game_logs, predictions, quotes, sql, table

from .registry import query
from .trading_queries import NAME
from .window_queries import PW


@query("upcoming_props", sql("quotes", """SELECT game_id, player_id, market_key, sportsbook_id, line_value, snapshot_id, over_odds, under_odds FROM quotes WHERE game_id < 5
 QUALIFY ROW_NUMBER() OVER (PARTITION BY game_id, player_id, market_key, sportsbook_id, line_value ORDER BY ts DESC, snapshot_id DESC) = 1"""))
def upcoming_props(spark, sf):
    q = quotes(spark, sf).where("game_id < 5")
    return Q.latest(q, "game_id", "player_id", "market_key", "sportsbook_id", "line_value").select("game_id", "player_id", "market_key", "sportsbook_id", "line_value", "snapshot_id", "over_odds", "under_odds")


@query("upcoming_lines", sql("quotes", """v AS (SELECT * FROM quotes WHERE json_valid(meta) AND TRY_CAST(json_extract_string(meta, '$.k') AS BIGINT) >= 20),
d AS (SELECT MAX(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE)) AS day FROM v),
b AS (SELECT v.* FROM v, d WHERE CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) >= d.day - 6 QUALIFY ROW_NUMBER() OVER (PARTITION BY game_id, player_id, market_key, sportsbook_id, line_value ORDER BY ts DESC, snapshot_id DESC) = 1),
c AS (SELECT game_id, player_id, market_key, quantile_cont(line_value, 0.5) AS consensus_line, COUNT(DISTINCT sportsbook_id) AS books FROM b GROUP BY ALL)
SELECT b.snapshot_id, game_id, player_id, market_key, sportsbook_id, line_value, consensus_line, books, abs(line_value - consensus_line) AS distance FROM b LEFT JOIN c USING (game_id, player_id, market_key)"""))
def upcoming_lines(spark, sf):
    q = quotes(spark, sf).where(F.get_json_object("meta", "$.k").try_cast("long") >= 20)
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York"))
    last = q.agg(F.max(day).alias("last"))
    b = Q.latest(q.withColumn("day", day).crossJoin(F.broadcast(last)).where("day >= date_sub(last, 6)"), "game_id", "player_id", "market_key", "sportsbook_id", "line_value")
    c = b.groupBy("game_id", "player_id", "market_key").agg(F.percentile("line_value", F.lit(0.5)).alias("consensus_line"), F.count_distinct("sportsbook_id").alias("books"))
    j = b.join(c, ["game_id", "player_id", "market_key"], "left")
    return j.select("snapshot_id", "game_id", "player_id", "market_key", "sportsbook_id", "line_value", "consensus_line", "books", F.abs(F.col("line_value") - F.col("consensus_line")).alias("distance"))


@query("latest_predictions", """WITH p AS (SELECT o_custkey AS player_id, o_orderpriority AS market, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 3 END AS snapshot, o_orderkey AS prediction_id, o_orderdate AS predicted_at, o_totalprice AS mean FROM orders)
SELECT player_id, market, COALESCE(snapshot, 0) AS snapshot, prediction_id, mean FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY player_id, market, COALESCE(snapshot, 0) ORDER BY predicted_at DESC, prediction_id DESC) = 1""")
def latest_predictions(spark, sf):
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("player_id"), F.col("o_orderpriority").alias("market"), F.coalesce(F.when(k % 4 != 0, k % 3), F.lit(0)).alias("snapshot"), k.alias("snapshot_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("mean"))
    return Q.latest(p, "player_id", "market", "snapshot").select("player_id", "market", "snapshot", F.col("snapshot_id").alias("prediction_id"), "mean")


@query("odds_history", sql("quotes", "SELECT player_id, market_key, ROW_NUMBER() OVER (PARTITION BY player_id, market_key ORDER BY ts, snapshot_id) AS place, snapshot_id, line_value, over_odds, under_odds FROM quotes"))
def odds_history(spark, sf):
    w = Window.partitionBy("player_id", "market_key").orderBy("ts", "snapshot_id")
    return quotes(spark, sf).select("player_id", "market_key", F.row_number().over(w).cast("long").alias("place"), "snapshot_id", "line_value", "over_odds", "under_odds")


@query("top_opportunities", sql("predictions", """s AS (SELECT player_id, game_id, market, p, abs(p - 0.5) AS score, line FROM predictions)
SELECT ROW_NUMBER() OVER (ORDER BY score DESC, p DESC, line DESC, game_id, player_id) AS rank, player_id, game_id, market, p FROM s ORDER BY score DESC, p DESC, line DESC, game_id, player_id LIMIT 50"""))
def top_opportunities(spark, sf):
    order = [F.desc("score"), F.desc("p"), F.desc("line"), F.asc("game_id"), F.asc("player_id")]
    top = predictions(spark, sf).withColumn("score", F.abs(F.col("p") - 0.5)).orderBy(*order).limit(50)  # the report's fifty
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "player_id", "game_id", "market", "p")


@query("extreme_predictions", sql("predictions", "SELECT player_id, game_id, market, p, p >= 0.93 OR p <= 0.04 AS critical FROM predictions WHERE p >= 0.9 OR p <= 0.1"))
def extreme_predictions(spark, sf):
    p = F.col("p")
    return predictions(spark, sf).where((p >= 0.9) | (p <= 0.1)).select("player_id", "game_id", "market", "p", ((p >= 0.93) | (p <= 0.04)).alias("critical"))


@query("upcoming_games", sql("game_logs", "SELECT game_date, team_id, opponent_team_id, game_id, start_time FROM game_logs QUALIFY ROW_NUMBER() OVER (PARTITION BY game_date, team_id, opponent_team_id ORDER BY start_time, game_id) = 1"))
def upcoming_games(spark, sf):
    g = game_logs(spark, sf).groupBy("game_date", "team_id", "opponent_team_id").agg(F.min(F.struct("start_time", "game_id")).alias("g"))
    return g.select("game_date", "team_id", "opponent_team_id", "g.game_id", "g.start_time")


@query("player_search", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_name ILIKE '%er#0000001%' ORDER BY c_name, c_custkey LIMIT 25")
def player_search(spark, sf):
    c = table(spark, sf, "customer").where(F.ilike("c_name", F.lit("%er#0000001%"))).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return c.orderBy("c_name", "c_custkey").limit(25).select("c_custkey", "c_name", "n_name")  # the search's page


@query("props_page", sql("predictions", "SELECT player_id, game_id, market, p, (SELECT COUNT(*) FROM predictions WHERE market = 'points' AND p >= 0.55) AS total FROM predictions WHERE market = 'points' AND p >= 0.55 ORDER BY p DESC, game_id, player_id LIMIT 20 OFFSET 40"))
def props_page(spark, sf):
    f = predictions(spark, sf).where("market = 'points' and p >= 0.55")
    page = f.orderBy(F.desc("p"), "game_id", "player_id").offset(40).limit(20).select("player_id", "game_id", "market", "p")
    return page.crossJoin(F.broadcast(f.agg(F.count(F.lit(1)).alias("total"))))


@query("game_teams", "SELECT o_orderkey AS game_id, h.n_name AS home, a.n_name AS away FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation h ON h.n_nationkey = c_nationkey JOIN nation a ON a.n_nationkey = (c_nationkey + 1 + o_orderkey % 24) % 25")
def game_teams(spark, sf):
    n = table(spark, sf, "nation")
    g = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("game_id"), F.col("c_nationkey").cast("long").alias("h"), ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).alias("a"))
    team = lambda k, name: n.select(F.col("n_nationkey").cast("long").alias(k), F.col("n_name").alias(name))
    return g.join(team("h", "home"), "h").join(team("a", "away"), "a").select("game_id", "home", "away")


@query("calibration_metrics", sql("predictions", "SELECT market, AVG(0.9 * p + 0.05) AS avg_calibrated, AVG(p) AS avg_raw FROM predictions GROUP BY market"))
def calibration_metrics(spark, sf):
    return predictions(spark, sf).groupBy("market").agg(F.avg(0.9 * F.col("p") + 0.05).alias("avg_calibrated"), F.avg("p").alias("avg_raw"))


@query("board_availability", sql("game_logs", "SELECT game_date, COUNT(*) FILTER (WHERE status = 'P') AS scheduled, COUNT(*) FILTER (WHERE status = 'O') AS live, COUNT(*) FILTER (WHERE status NOT IN ('P', 'O')) AS final FROM game_logs GROUP BY game_date"))
def board_availability(spark, sf):
    s = F.col("status")
    return game_logs(spark, sf).groupBy("game_date").agg(F.count_if(s == "P").alias("scheduled"), F.count_if(s == "O").alias("live"), F.count_if(~s.isin("P", "O")).alias("final"))


@query("edge_buckets", sql("predictions", """b(bucket, lo, hi) AS (VALUES ('low_edge', 0.45::DOUBLE, 0.55::DOUBLE), ('medium_edge', 0.35::DOUBLE, 0.65::DOUBLE), ('high_edge', 0.20::DOUBLE, 0.80::DOUBLE))
SELECT bucket, market, COUNT(*) AS n, AVG((p - y) * (p - y)) AS brier, AVG(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, AVG(p) - AVG(y) AS gap FROM predictions, b WHERE p <= lo OR p >= hi GROUP BY bucket, market"""))
def edge_buckets(spark, sf):
    p, y = F.col("p"), F.col("y")
    cuts = {"low_edge": (0.45, 0.55), "medium_edge": (0.35, 0.65), "high_edge": (0.20, 0.80)}
    hits = F.array_compact(F.array(*[F.when((p <= a) | (p >= b), F.lit(k)) for k, (a, b) in cuts.items()]))
    r = predictions(spark, sf).withColumn("bucket", F.explode(hits))
    return r.groupBy("bucket", "market").agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(F.when((p >= 0.5) == (y == 1), 1.0).otherwise(0.0)).alias("accuracy"), (F.avg(p) - F.avg(y)).alias("gap"))


@query("calibration_health", sql("predictions", """b AS (SELECT market, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, AVG(p) AS mp, AVG(y) AS hy, COUNT(*) AS n FROM predictions GROUP BY ALL),
e AS (SELECT market, SUM(abs(hy - mp) * n) / SUM(n) AS ece, CAST(SUM(n) AS BIGINT) AS n FROM b GROUP BY market) SELECT MIN(n) AS samples_min, MAX(n) AS samples_max, round(AVG(ece), 6) AS ece_mean, round(MAX(ece), 6) AS ece_max FROM e"""))
def calibration_health(spark, sf):
    e = M.ece(predictions(spark, sf), M.left_closed(F.col("p")), "market")
    return e.agg(F.min("n").alias("samples_min"), F.max("n").alias("samples_max"), F.round(F.avg("ece"), 6).alias("ece_mean"), F.round(F.max("ece"), 6).alias("ece_max"))


@query("fold_drift", sql("predictions", """q AS (SELECT *, date_trunc('quarter', game_date) AS fold FROM predictions), f AS (SELECT market, fold, AVG(abs(line - actual)) AS mae, AVG((p - y) * (p - y)) AS brier FROM q GROUP BY ALL),
b AS (SELECT market, fold, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, AVG(p) AS mp, AVG(y) AS hy, COUNT(*) AS n FROM q GROUP BY ALL), c AS (SELECT market, fold, SUM(abs(hy - mp) * n) / SUM(n) AS ece FROM b GROUP BY ALL),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY market ORDER BY fold) - 1 AS i, COUNT(*) OVER (PARTITION BY market) AS n FROM f JOIN c USING (market, fold)), e AS (SELECT *, i < n // 2 AS early FROM k WHERE n >= 3)
SELECT market, """ + ", ".join(f"AVG({c}) FILTER (WHERE early) AS early_{c}, AVG({c}) FILTER (WHERE NOT early) AS late_{c}" for c in ("mae", "brier", "ece")) + """, AVG(mae) FILTER (WHERE NOT early) - AVG(mae) FILTER (WHERE early) AS mae_drift, AVG(brier) FILTER (WHERE NOT early) - AVG(brier) FILTER (WHERE early) AS brier_drift,
  COUNT(*) FILTER (WHERE early) AS folds_early, COUNT(*) FILTER (WHERE NOT early) AS folds_late FROM e GROUP BY market"""))
def fold_drift(spark, sf):
    d, e = F.col("p") - F.col("y"), F.col("line") - F.col("actual")
    rows = predictions(spark, sf).withColumn("fold", F.date_trunc("quarter", "game_date"))
    f = rows.groupBy("market", "fold").agg(F.avg(F.abs(e)).alias("mae"), F.avg(d * d).alias("brier")).join(M.ece(rows, M.left_closed(F.col("p")), "market", "fold").select("market", "fold", "ece"), ["market", "fold"])
    w = Window.partitionBy("market")  # a market's quarters: few rows
    k = f.withColumns({"i": F.row_number().over(w.orderBy("fold")) - 1, "n": F.count(F.lit(1)).over(w)}).where("n >= 3").withColumn("early", F.col("i") < F.floor(F.col("n") / 2))
    early, late = lambda c: F.avg(F.when(F.col("early"), F.col(c))), lambda c: F.avg(F.when(~F.col("early"), F.col(c)))
    return k.groupBy("market").agg(*[x for c in ("mae", "brier", "ece") for x in (early(c).alias(f"early_{c}"), late(c).alias(f"late_{c}"))], (late("mae") - early("mae")).alias("mae_drift"), (late("brier") - early("brier")).alias("brier_drift"),
                                   F.count_if("early").alias("folds_early"), F.count_if(~F.col("early")).alias("folds_late"))


@query("line_distance", sql("quotes", "SELECT snapshot_id, abs(line_value - median(line_value) OVER (PARTITION BY game_id, player_id, market_key)) AS distance FROM quotes"))
def line_distance(spark, sf):
    keys = ["game_id", "player_id", "market_key"]
    q = quotes(spark, sf).select(*keys, "snapshot_id", "line_value")
    mid = q.groupBy(*keys).agg(F.percentile("line_value", F.lit(0.5)).alias("mid"))
    return q.join(mid, keys).select("snapshot_id", F.abs(F.col("line_value") - F.col("mid")).alias("distance"))


def _f(x: str, rows: str) -> str:
    return f"AVG(CAST({x} AS DOUBLE)) OVER ({PW} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


@query("blended_features", sql("game_logs", f"""r AS (SELECT player_id, game_id, starter, {_f('points', '5')} AS a5, {_f('points', '20')} AS a20, {_f('points', 'UNBOUNDED')} AS s, list(CAST(points AS DOUBLE)) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS xs FROM game_logs),
e AS (SELECT *, list_reduce(xs, lambda s, x: (1 - 2.0::DOUBLE / 11) * s + 2.0::DOUBLE / 11 * x) AS w FROM r)
SELECT player_id, game_id, (1 - x) * (0.55::DOUBLE * COALESCE(a5, 0) + 0.45::DOUBLE * COALESCE(w, 0)) + x * (0.65::DOUBLE * COALESCE(a20, 0) + 0.35::DOUBLE * COALESCE(s, 0)) AS points_blended FROM (SELECT *, CASE WHEN starter THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS x FROM e)"""))
def blended_features(spark, sf):
    w, y = W.by("player_id"), F.col("points").cast("double")
    mean = lambda n: F.coalesce(F.avg(y).over(W.before(w, n)), F.lit(0.0))
    d = frames.ewm_sums(game_logs(spark, sf), ("points",), F.col("points").isNotNull())
    return d.select("player_id", "game_id", W.blended(mean(5), F.coalesce("points_ewm", F.lit(0.0)), mean(20), mean(None), F.when(F.col("starter"), 0.8).otherwise(0.5)).alias("points_blended"))


@query("market_group", sql("game_logs", """m AS (SELECT MAX(abs(minutes)) AS a, MAX(abs(points)) AS b, MAX(abs(threes)) AS c FROM game_logs)
SELECT player_id, game_id, 0.4::DOUBLE * (CASE WHEN a > 5 THEN ln(1 + greatest(minutes, 0)) ELSE minutes END + CASE WHEN b > 5 THEN ln(1 + greatest(points, 0)) ELSE points END + CASE WHEN c > 5 THEN ln(1 + greatest(threes, 0)) ELSE threes END) / 3 AS group_volume FROM game_logs, m"""))
def market_group(spark, sf):
    return W.market_group(game_logs(spark, sf), {"volume": (0.4, ("minutes", "points", "threes"))}).select("player_id", "game_id", "group_volume")


@query("post_minutes", sql("game_logs", f"""r AS (SELECT player_id, game_id, COALESCE({_f('minutes', '10')}, 0) AS m, COALESCE(STDDEV_SAMP(minutes) OVER ({PW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS sd, 90.0::DOUBLE + team_id AS pace FROM game_logs)
SELECT player_id, game_id, greatest(pace * m / 48, 0) AS expected_possessions, sd / greatest(m, 1.0) AS minutes_uncertainty FROM r"""))
def post_minutes(spark, sf):
    f = W.before(W.by("player_id"), 10)
    m, sd = F.coalesce(F.avg("minutes").over(f), F.lit(0.0)), F.coalesce(F.stddev_samp("minutes").over(f), F.lit(0.0))
    g = game_logs(spark, sf).select("player_id", "game_id", m.alias("m"), sd.alias("sd"), (90.0 + F.col("team_id")).alias("pace"))
    return g.select("player_id", "game_id", F.greatest(F.col("pace") * F.col("m") / 48, F.lit(0.0)).alias("expected_possessions"), (F.col("sd") / F.greatest("m", F.lit(1.0))).alias("minutes_uncertainty"))


@query("pit_midrank", sql("game_logs", """a AS (SELECT player_id, game_id, points FROM game_logs), c AS (SELECT player_id, points, COUNT(*) AS k FROM a GROUP BY ALL), r AS (SELECT player_id, points, k, SUM(k) OVER (PARTITION BY player_id ORDER BY points) - k AS lt, SUM(k) OVER (PARTITION BY player_id) AS n FROM c)
SELECT a.player_id, a.game_id, least(greatest((lt + 0.5 * k) / n, 1e-6), 1 - 1e-6)::DOUBLE AS pit FROM a JOIN r USING (player_id, points)"""))
def pit_midrank(spark, sf):
    return M.midrank(game_logs(spark, sf).select("player_id", "game_id", "points"), "player_id", "points").select("player_id", "game_id", "pit")


@query("outcomes_join", sql("predictions game_logs", """x AS (SELECT p.player_id, p.game_id, p.market, p.line, CASE p.market WHEN 'points' THEN g.points WHEN 'assists' THEN g.assists WHEN 'threes' THEN g.threes END AS stat, g.status FROM predictions p JOIN game_logs g USING (player_id, game_id))
SELECT player_id, game_id, market, CAST(CASE WHEN status = 'F' THEN COALESCE(stat, 0) ELSE stat END AS BIGINT) AS stat, stat > line AS hit FROM x"""))
def outcomes_join(spark, sf):
    g = game_logs(spark, sf).select("player_id", "game_id", "points", "assists", "threes", "status")
    j = predictions(spark, sf).select("player_id", "game_id", "market", "line").join(g, ["player_id", "game_id"])
    stat = F.coalesce(*[F.when(F.col("market") == m, F.col(m)) for m in ("points", "assists", "threes")])
    return j.select("player_id", "game_id", "market", F.when(F.col("status") == "F", F.coalesce(stat, F.lit(0))).otherwise(stat).alias("stat"), (stat > F.col("line")).alias("hit"))


@query("quote_scoring", sql("quotes predictions", """q AS (SELECT player_id, CAST(snapshot_id % 3000 AS BIGINT) AS game_id, snapshot_id, line_value FROM quotes)
SELECT snapshot_id, q.player_id, q.game_id, p.actual, CASE WHEN p.actual > q.line_value THEN 1 ELSE 0 END AS label FROM q JOIN predictions p ON p.player_id = q.player_id AND p.game_id % 3000 = q.game_id"""))
def quote_scoring(spark, sf):
    q = quotes(spark, sf).select("snapshot_id", "player_id", "line_value", (F.col("snapshot_id") % 3000).alias("g"))
    p = predictions(spark, sf).select("player_id", (F.col("game_id") % 3000).alias("g"), "actual")
    return q.join(p, ["player_id", "g"]).select("snapshot_id", "player_id", F.col("g").alias("game_id"), "actual", F.when(F.col("actual") > F.col("line_value"), 1).otherwise(0).alias("label"))


@query("consistency_payload", sql("game_logs", f"""r AS (SELECT player_id, game_date, game_id, {_f('points', '10')} AS points, {_f('assists', '10')} AS assists, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS k FROM game_logs)
SELECT player_id, m.market, m.value FROM (SELECT player_id, unnest([{{'market': 'points', 'value': points}}, {{'market': 'assists', 'value': assists}}]) AS m FROM r WHERE k = 1)"""))
def consistency_payload(spark, sf):
    f = W.before(W.by("player_id"), 10)
    g = game_logs(spark, sf).select("player_id", "game_date", "game_id", *[F.avg(F.col(c).cast("double")).over(f).alias(c) for c in ("points", "assists")])
    last = g.groupBy("player_id").agg(F.max_by(F.array(*[F.struct(F.lit(c).alias("market"), F.col(c).alias("value")) for c in ("points", "assists")]), F.struct("game_date", "game_id")).alias("m"))
    return last.select("player_id", F.explode("m").alias("x")).select("player_id", "x.market", "x.value")


@query("history_scope", sql("game_logs", "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT player_id) AS players, COUNT(DISTINCT game_id) AS games, MIN(game_date) AS first_day, MAX(game_date) AS last_day, (SELECT COUNT(*) FROM (SELECT team_id AS t FROM game_logs UNION SELECT opponent_team_id FROM game_logs)) AS teams FROM game_logs"))
def history_scope(spark, sf):
    g = game_logs(spark, sf)
    teams = g.select(F.explode(F.array("team_id", "opponent_team_id")).alias("t")).agg(F.count_distinct("t").alias("teams"))
    return g.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("player_id").alias("players"), F.count_distinct("game_id").alias("games"), F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day")).crossJoin(F.broadcast(teams))


@query("minute_rates", sql("game_logs", "SELECT player_id, AVG(CASE WHEN minutes > 0 THEN points / minutes END) AS points_per_minute FROM game_logs GROUP BY player_id"))
def minute_rates(spark, sf):
    return game_logs(spark, sf).groupBy("player_id").agg(F.avg(F.try_divide(F.col("points").cast("double"), "minutes")).alias("points_per_minute"))


@query("name_resolution", f"""WITH k AS (SELECT c_custkey AS player_id, {NAME} AS name FROM customer), w AS (SELECT s_suppkey AS entity_id, replace({NAME.replace('c_name', 's_name')}, 'supplier', CASE WHEN s_suppkey % 2 = 0 THEN 'customer' ELSE 'custmer' END) AS name FROM supplier),
x AS (SELECT entity_id, MIN(player_id) AS player_id FROM w JOIN k USING (name) GROUP BY entity_id),
c AS (SELECT w.entity_id, k.player_id, w.name AS a, k.name AS b, (CAST(1 AS BIGINT) << length(k.name)) - 1 AS allbits FROM w, k WHERE w.entity_id NOT IN (SELECT entity_id FROM x)),
m AS (SELECT *, list_transform(string_split(a, ''), lambda ch: CAST(list_sum(list_transform(range(0, length(b)), lambda i: CASE WHEN substr(b, CAST(i + 1 AS INTEGER), 1) = ch THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT)) AS masks FROM c),
l AS (SELECT entity_id, player_id, a, b, length(b) - bit_count(list_reduce(list_prepend(allbits, masks), lambda v, m: ((v + (v & m)) | (v - (v & m))) & allbits)) AS common FROM m),
b AS (SELECT entity_id, player_id, 2.0::DOUBLE * common / (length(a) + length(b)) AS score FROM l WHERE 2.0::DOUBLE * common / (length(a) + length(b)) >= 0.9::DOUBLE - 1e-12 QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY score DESC, player_id) = 1)
SELECT entity_id, player_id, 1.0::DOUBLE AS confidence FROM x UNION ALL SELECT entity_id, player_id, score FROM b""")
def name_resolution(spark, sf):
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), X.normalize_name(F.col("c_name")).alias("name"))
    wanted = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.replace(X.normalize_name(F.col("s_name")), F.lit("supplier"), F.when(F.col("s_suppkey") % 2 == 0, "customer").otherwise("custmer")).alias("name"))
    return matching.resolve_names(wanted, known, 0.9)
