"""Metrics, tiers, priors and grading over the role views."""

from pyspark.sql import functions as F

from hardwood.operators import metrics as M
from hardwood.sources.roles import game_logs, predictions, quotes, sql, table

from .registry import query

RIGHT, LEFT = "CAST(greatest(ceil(p * 10) - 1, 0) AS BIGINT)", "CAST(least(floor(p * 10), 9) AS BIGINT)"


def _ece(bin_: str, by: str) -> str:
    return f"b AS (SELECT {by}, {bin_} AS bin, AVG(p) AS mp, AVG(y) AS hy, COUNT(*) AS n FROM predictions GROUP BY ALL) SELECT {by}, SUM(abs(hy - mp) * n) / SUM(n) AS ece, CAST(SUM(n) AS BIGINT) AS n FROM b GROUP BY {by}"


@query("regression_metrics", sql("predictions", "SELECT market, AVG(abs(line - actual)) AS mae, sqrt(AVG((line - actual) * (line - actual))) AS rmse, COUNT(*) AS n FROM predictions GROUP BY market"))
def regression_metrics(spark, sf):
    d = F.col("line") - F.col("actual")
    return predictions(spark, sf).groupBy("market").agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query("prob_metrics", sql("predictions", "SELECT market, AVG(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, AVG((p - y) * (p - y)) AS brier FROM predictions GROUP BY market"))
def prob_metrics(spark, sf):
    p, y = F.col("p"), F.col("y")
    return predictions(spark, sf).groupBy("market").agg(M.log_loss(p, y).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"))


@query("ece_right", sql("predictions", _ece(RIGHT, "market")))
def ece_right(spark, sf):
    return M.ece(predictions(spark, sf), M.right_closed(F.col("p")), "market")


@query("ece_left", sql("predictions", _ece(LEFT, "market")))
def ece_left(spark, sf):
    return M.ece(predictions(spark, sf), M.left_closed(F.col("p")), "market")


@query("reliability", sql("predictions", f"SELECT market, {LEFT} AS bin, AVG(p) AS mean_p, AVG(y) AS hit_rate, COUNT(*) AS n FROM predictions GROUP BY ALL"))
def reliability(spark, sf):
    return M.reliability(predictions(spark, sf), M.left_closed(F.col("p")), "market")


@query("threshold_table", sql("predictions", "SELECT CAST(c AS DOUBLE) AS cut, COUNT(*) AS n, AVG(y) AS hit_rate, AVG(p) AS expected FROM predictions, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS c) WHERE p >= CAST(c AS DOUBLE) GROUP BY c"))
def threshold_table(spark, sf):
    return M.thresholds(predictions(spark, sf), (0.5, 0.6, 0.7, 0.8, 0.9))


@query("line_tiers", sql("predictions", "SELECT market, CASE WHEN line < 8 THEN 'low' WHEN line < 16 THEN 'mid' ELSE 'high' END AS tier, COUNT(*) AS n, AVG(y) AS hit_rate, AVG(p) AS mean_p, AVG((p - y) * (p - y)) AS brier FROM predictions GROUP BY ALL HAVING COUNT(*) >= 5"))
def line_tiers(spark, sf):
    tier = F.when(F.col("line") < 8, "low").when(F.col("line") < 16, "mid").otherwise("high")
    d = F.col("p") - F.col("y")
    return predictions(spark, sf).groupBy("market", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("hit_rate"), F.avg("p").alias("mean_p"), F.avg(d * d).alias("brier")).where("n >= 5")


@query("weekly_decay", sql("predictions", "SELECT is_home, CAST(floor(date_diff('day', game_date, (SELECT MAX(game_date) FROM predictions)) / 7) AS BIGINT) AS weeks_ago, COUNT(*) AS n, AVG(y) AS hit_rate, AVG(p) AS mean_p FROM predictions GROUP BY ALL HAVING COUNT(*) >= 5"))
def weekly_decay(spark, sf):
    d = predictions(spark, sf)
    d = d.crossJoin(F.broadcast(d.agg(F.max("game_date").alias("last"))))
    return d.groupBy("is_home", F.floor(F.datediff("last", "game_date") / 7).cast("long").alias("weeks_ago")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("hit_rate"), F.avg("p").alias("mean_p")).where("n >= 5")


@query("player_bias", sql("predictions", """o AS (SELECT player_id, market, CASE WHEN actual > line THEN 1.0 ELSE 0.0 END AS o FROM predictions WHERE actual <> line), m AS (SELECT market, AVG(o) AS prior FROM o GROUP BY market),
g AS (SELECT player_id, COUNT(*) AS n, AVG(o) AS raw, AVG(prior) AS prior FROM o JOIN m USING (market) GROUP BY player_id HAVING COUNT(*) >= 5) SELECT player_id, n, round(0.5 - (n * raw + 20.0 * prior) / (n + 20.0), 4) AS "offset" FROM g"""))
def player_bias(spark, sf):
    return M.shrunk_offsets(predictions(spark, sf).where("actual <> line").select("player_id", "market", F.when(F.col("actual") > F.col("line"), 1.0).otherwise(0.0).alias("over")))


@query("pit_ks", sql("predictions", """r AS (SELECT market, p AS v, ROW_NUMBER() OVER (PARTITION BY market ORDER BY p, game_id, player_id) AS i, COUNT(*) OVER (PARTITION BY market) AS n FROM predictions)
SELECT market, MAX(greatest(CAST(i AS DOUBLE) / n - v, v - CAST(i - 1 AS DOUBLE) / n)) AS ks, any_value(n) AS n FROM r GROUP BY market"""))
def pit_ks(spark, sf):
    return M.pit_ks(predictions(spark, sf).select("market", F.col("p").alias("v")), "market")


@query("sufficiency_tiers", sql("game_logs", """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY game_date DESC, start_time DESC, game_id DESC) AS k FROM game_logs),
a AS (SELECT player_id, COUNT(DISTINCT game_id) AS games, SUM(minutes) AS minutes, AVG(minutes) FILTER (WHERE k <= 10) AS recent FROM r GROUP BY player_id)
SELECT *, CASE WHEN games >= 10 AND minutes >= 100 AND recent >= 12 THEN 'A' WHEN games >= 5 AND minutes >= 50 THEN 'B' WHEN games >= 1 THEN 'C' ELSE 'D' END AS tier FROM a"""))
def sufficiency_tiers(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("start_time"), F.desc("game_id"))
    a = game_logs(spark, sf).withColumn("k", F.row_number().over(w)).groupBy("player_id").agg(F.count_distinct("game_id").alias("games"), F.sum("minutes").alias("minutes"), F.avg(F.when(F.col("k") <= 10, F.col("minutes"))).alias("recent"))
    return a.withColumn("tier", F.expr("CASE WHEN games >= 10 AND minutes >= 100 AND recent >= 12 THEN 'A' WHEN games >= 5 AND minutes >= 50 THEN 'B' WHEN games >= 1 THEN 'C' ELSE 'D' END"))


@query("population_priors", sql("game_logs", "SELECT COALESCE(position, 'all') AS position, CASE WHEN GROUPING(starter) = 1 THEN 'all' WHEN starter THEN 'starter' ELSE 'bench' END AS role, AVG(minutes) AS minutes, AVG(points) AS points, AVG(assists) AS assists, COUNT(*) AS n FROM game_logs GROUP BY GROUPING SETS ((), (position), (starter))"))
def population_priors(spark, sf):
    game_logs(spark, sf).createOrReplaceTempView("hardwood_logs")
    return spark.sql("""SELECT coalesce(position, 'all') AS position, CASE WHEN grouping(starter) = 1 THEN 'all' WHEN starter THEN 'starter' ELSE 'bench' END AS role,
      avg(minutes) AS minutes, avg(points) AS points, avg(assists) AS assists, count(*) AS n FROM hardwood_logs GROUP BY GROUPING SETS ((), (position), (starter))""")


@query("rotation_weights", sql("game_logs", """c AS (SELECT CAST(team_id AS VARCHAR) AS team, position AS absent, CAST(opponent_team_id % 5 AS BIGINT) AS candidate, AVG(minutes) AS mean, VAR_SAMP(minutes) AS var, COUNT(*) AS n FROM game_logs GROUP BY ALL
 UNION ALL SELECT 'LEAGUE', position, CAST(opponent_team_id % 5 AS BIGINT), AVG(minutes), VAR_SAMP(minutes), COUNT(*) FROM game_logs GROUP BY ALL),
s AS (SELECT *, CASE WHEN var > 0 THEN n / var END AS score FROM c)
SELECT team, absent, candidate, mean, n, CASE WHEN SUM(score) OVER w > 0 THEN COALESCE(score, 0.0) / SUM(score) OVER w ELSE 1.0 / COUNT(*) OVER w END AS weight FROM s WINDOW w AS (PARTITION BY team, absent)"""))
def rotation_weights(spark, sf):
    from pyspark.sql import Window

    g = game_logs(spark, sf).select(F.col("team_id").cast("string").alias("team"), F.col("position").alias("absent"), (F.col("opponent_team_id") % 5).cast("long").alias("candidate"), "minutes")
    cell = lambda d: d.groupBy("team", "absent", "candidate").agg(F.avg("minutes").alias("mean"), F.var_samp("minutes").alias("var"), F.count(F.lit(1)).alias("n"))
    s = cell(g).unionByName(cell(g.withColumn("team", F.lit("LEAGUE")))).withColumn("score", F.when(F.col("var") > 0, F.col("n") / F.col("var")))
    w = Window.partitionBy("team", "absent")
    total = F.sum("score").over(w)
    return s.select("team", "absent", "candidate", "mean", "n", F.when(total > 0, F.coalesce("score", F.lit(0.0)) / total).otherwise(1.0 / F.count(F.lit(1)).over(w)).alias("weight"))


@query("volatility", sql("game_logs", """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY game_date DESC, start_time DESC, game_id DESC) AS k FROM game_logs),
a AS (SELECT player_id, AVG(points) FILTER (WHERE k <= 5) AS m5, AVG(points) FILTER (WHERE k <= 10) AS m10, STDDEV_SAMP(points) FILTER (WHERE k <= 10) AS s10, AVG(points) FILTER (WHERE k <= 82) AS ms, STDDEV_SAMP(points) FILTER (WHERE k <= 82) AS ss, AVG(CASE WHEN starter THEN 1.0 ELSE 0.0 END) FILTER (WHERE k <= 10) AS st FROM r GROUP BY player_id),
b AS (SELECT *, CASE WHEN s10 / nullif(m10, 0) IS NOT NULL THEN least(s10 / nullif(m10, 0) / 0.6, 1.0) END AS x1, CASE WHEN (m5 - ms) / nullif(ss, 0) IS NOT NULL THEN least(abs(m5 - ms) / nullif(ss, 0) / 1.5, 1.0) END AS x2, 1 - abs(2 * st - 1) AS x3 FROM a),
v AS (SELECT player_id, COALESCE((0.5 * COALESCE(x1, 0) + 0.3 * COALESCE(x2, 0) + 0.2 * COALESCE(x3, 0)) / nullif(CASE WHEN x1 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN x2 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN x3 IS NULL THEN 0 ELSE 0.2 END, 0), 0.5) AS volatility FROM b)
SELECT player_id, volatility, CASE WHEN volatility < 0.33 THEN 'low' WHEN volatility < 0.66 THEN 'medium' ELSE 'high' END AS tier FROM v"""))
def volatility(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("start_time"), F.desc("game_id"))
    of = lambda c, n: F.when(F.col("k") <= n, F.col(c))
    a = game_logs(spark, sf).withColumn("k", F.row_number().over(w)).withColumn("s", F.when(F.col("starter"), 1.0).otherwise(0.0)).groupBy("player_id").agg(
        F.avg(of("points", 5)).alias("m5"), F.avg(of("points", 10)).alias("m10"), F.stddev_samp(of("points", 10)).alias("s10"), F.avg(of("points", 82)).alias("ms"), F.stddev_samp(of("points", 82)).alias("ss"), F.avg(of("s", 10)).alias("st"))
    one = F.lit(1.0)
    cap = lambda x: F.when(x.isNotNull(), F.least(x, one))
    x = [cap(F.try_divide("s10", "m10") / 0.6), cap(F.try_divide(F.abs(F.col("m5") - F.col("ms")), F.col("ss")) / 1.5), 1 - F.abs(2 * F.col("st") - 1)]
    weights = (0.5, 0.3, 0.2)
    top = sum((F.coalesce(c, F.lit(0.0)) * k for c, k in zip(x, weights, strict=True)), F.lit(0.0))
    low = sum((F.when(c.isNull(), 0.0).otherwise(k) for c, k in zip(x, weights, strict=True)), F.lit(0.0))
    return a.select("player_id", F.coalesce(F.try_divide(top, low), F.lit(0.5)).alias("volatility")).withColumn("tier", F.expr("CASE WHEN volatility < 0.33 THEN 'low' WHEN volatility < 0.66 THEN 'medium' ELSE 'high' END"))


@query("prop_grading", sql("predictions", """o AS (SELECT *, actual > line AS hit FROM predictions WHERE actual <> line) SELECT COALESCE(market, 'all') AS market, COALESCE(CAST(floor(p * 10) / 10 AS DOUBLE), -1.0) AS bucket, COUNT(*) AS n, COUNT(*) FILTER (WHERE hit) AS overs, AVG(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS over_rate FROM o GROUP BY GROUPING SETS ((), (market), (floor(p * 10) / 10))"""))
def prop_grading(spark, sf):
    predictions(spark, sf).where("actual <> line").selectExpr("market", "floor(p * 10) / 10.0D AS b", "actual > line AS hit").createOrReplaceTempView("hardwood_graded")
    return spark.sql("""SELECT coalesce(market, 'all') AS market, coalesce(b, -1.0D) AS bucket, count(*) AS n, count_if(hit) AS overs, avg(CASE WHEN hit THEN 1.0D ELSE 0.0D END) AS over_rate
      FROM hardwood_graded GROUP BY GROUPING SETS ((), (market), (b))""")


@query("lever_sim", sql("predictions", """r AS (SELECT y, unnest([{'l': 'all', 'k': true}, {'l': 'p60', 'k': p >= 0.6}, {'l': 'p70', 'k': p >= 0.7}, {'l': 'home', 'k': is_home}, {'l': 'no points', 'k': market <> 'points'}, {'l': 'p60 home', 'k': p >= 0.6 AND is_home}]) AS r FROM predictions)
SELECT r.l AS lever, COUNT(*) FILTER (WHERE r.k) AS kept, AVG(y) FILTER (WHERE r.k) AS hit_rate FROM r GROUP BY r.l"""))
def lever_sim(spark, sf):
    rules = {"all": F.lit(True), "p60": F.col("p") >= 0.6, "p70": F.col("p") >= 0.7, "home": F.col("is_home"), "no points": F.col("market") != "points", "p60 home": (F.col("p") >= 0.6) & F.col("is_home")}
    r = predictions(spark, sf).select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("lever"), v.alias("keep")) for k, v in rules.items()])).alias("r")).select("y", "r.*")
    return r.groupBy("lever").agg(F.count_if("keep").alias("kept"), F.avg(F.when(F.col("keep"), F.col("y"))).alias("hit_rate"))


@query("data_quality", sql("game_logs quotes", """SELECT 'short_games' AS check_name, COUNT(*) AS n FROM game_logs WHERE minutes < 5 UNION ALL SELECT 'duplicate_lines', COUNT(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1)
UNION ALL SELECT 'one_sided_quotes', COUNT(*) FROM quotes WHERE (over_odds IS NULL) <> (under_odds IS NULL) UNION ALL SELECT 'unknown_players', COUNT(*) FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = q.player_id)"""))
def data_quality(spark, sf):
    q = quotes(spark, sf)
    checks = {"short_games": game_logs(spark, sf).where("minutes < 5"), "duplicate_lines": table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
              "one_sided_quotes": q.where("(over_odds IS NULL) <> (under_odds IS NULL)"), "unknown_players": q.join(table(spark, sf, "customer"), F.col("player_id") == F.col("c_custkey"), "left_anti")}
    out = None
    for k, d in checks.items():
        one = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("recency_backtest", sql("game_logs", """f AS (SELECT player_id, game_id, game_date, CAST(points AS DOUBLE) AS y, LAG(CAST(points AS DOUBLE)) OVER w AS a1, AVG(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5, AVG(points) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a10,
 AVG(points) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a20, AVG(points) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM game_logs WINDOW w AS (PARTITION BY player_id ORDER BY game_date, start_time, game_id)),
b AS (SELECT *, .35::DOUBLE * a5 + .30::DOUBLE * a10 + .20::DOUBLE * a20 + .10::DOUBLE * s + .05::DOUBLE * a1 AS pred, CAST(floor(date_diff('day', (SELECT MIN(game_date) FROM f), game_date) / 182) AS BIGINT) AS fold FROM f WHERE a1 IS NOT NULL)
SELECT fold, COUNT(*) AS n, AVG(abs(pred - y)) AS mae, sqrt(AVG((pred - y) * (pred - y))) AS rmse FROM b GROUP BY fold"""))
def recency_backtest(spark, sf):
    from hardwood.operators import windows as W

    g, w = game_logs(spark, sf), W.by("player_id")
    y = F.col("points").cast("double")
    mean = lambda n: F.avg(y).over(W.before(w, n))
    f = g.select("game_date", y.alias("y"), F.lag(y).over(w).alias("a1"), mean(5).alias("a5"), mean(10).alias("a10"), mean(20).alias("a20"), mean(None).alias("s"))
    first = g.agg(F.min("game_date").alias("first"))
    b = f.where("a1 is not null").crossJoin(F.broadcast(first)).select("y", F.expr("0.35D * a5 + 0.30D * a10 + 0.20D * a20 + 0.10D * s + 0.05D * a1").alias("pred"), F.floor(F.datediff("game_date", "first") / 182).cast("long").alias("fold"))
    e = F.col("pred") - F.col("y")
    return b.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
