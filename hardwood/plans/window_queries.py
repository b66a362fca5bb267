"""Window features over the role views."""

from hardwood.operators import windows as W
from hardwood.sources.roles import game_logs, sql

from .registry import query

PW = "PARTITION BY player_id ORDER BY game_date, start_time, game_id"


def _mean(x: str, n: int, w: str = PW) -> str:
    least = min(max(3, n // 2), n)
    f = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN COUNT({x}) OVER {f} >= {least} THEN AVG({x}) OVER {f} END"


def _recent() -> str:
    out = []
    for m in ("minutes", "points"):
        x = f"CAST({m} AS DOUBLE)"
        means = [_mean(x, n) for n in (3, 5, 10, 20)]
        season = f"AVG({x}) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        std = lambda n: f"CASE WHEN COUNT({x}) OVER ({PW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= 3 THEN STDDEV_SAMP({x}) OVER ({PW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
        out.append(f"COALESCE(LAG({x}) OVER ({PW}), 0.0) AS {m}_prev")
        out += [f"COALESCE({', '.join(means[i:])}, {season}, 0.0) AS {m}_avg_{n}" for i, n in enumerate((3, 5, 10, 20))]
        out += [f"COALESCE({std(10)}, {std(20)}, 0.0) AS {m}_std_10", f"COALESCE({season}, 0.0) AS {m}_season_avg"]
    return "SELECT player_id, game_id, " + ", ".join(out) + " FROM game_logs"


@query("game_log_scan", sql("game_logs", "SELECT player_id, game_id, team_id, opponent_team_id, game_date, minutes, pra, is_home FROM game_logs WHERE status <> 'P' AND minutes >= 5"))
def game_log_scan(spark, sf):
    return game_logs(spark, sf).where("status <> 'P' and minutes >= 5").select("player_id", "game_id", "team_id", "opponent_team_id", "game_date", "minutes", "pra", "is_home")


@query("rolling_means", sql("game_logs", _recent()))
def rolling_means(spark, sf):
    return W.recent_features(game_logs(spark, sf))


@query("ewm_10", sql("game_logs", """g AS (SELECT player_id, game_id, CASE WHEN game_id %% 9 = 0 THEN NULL ELSE CAST(points AS DOUBLE) END AS x, ROW_NUMBER() OVER (%s) AS k FROM game_logs),
e AS (SELECT a.player_id, a.k, b.x, a.k - b.k AS d FROM g a JOIN g b ON a.player_id = b.player_id AND b.k < a.k),
s AS (SELECT player_id, game_id, k FROM g)
SELECT s.player_id, s.game_id, r.v AS points_ewm_10 FROM s LEFT JOIN (
  SELECT player_id, k, list_reduce(list_prepend({'v': CAST(NULL AS DOUBLE), 'w': 0.0::DOUBLE}, list({'v': x, 'w': 1.0::DOUBLE} ORDER BY d DESC)),
    lambda s, e: CASE WHEN e.v IS NULL THEN {'v': s.v, 'w': s.w * (1 - 2.0::DOUBLE / 11)} WHEN s.v IS NULL THEN {'v': e.v, 'w': 1.0::DOUBLE}
      ELSE {'v': (s.w * (1 - 2.0::DOUBLE / 11) * s.v + 2.0::DOUBLE / 11 * e.v) / (s.w * (1 - 2.0::DOUBLE / 11) + 2.0::DOUBLE / 11), 'w': 1.0::DOUBLE} END).v AS v
  FROM e GROUP BY player_id, k) r ON r.player_id = s.player_id AND r.k = s.k""" % PW))
def ewm_10(spark, sf):
    from pyspark.sql import functions as F

    x = F.when(F.col("game_id") % 9 != 0, F.col("points"))
    return W.ewm(game_logs(spark, sf), x, "points_ewm_10").select("player_id", "game_id", "points_ewm_10")


@query("dnp_anomalies", sql("game_logs", f"""m AS (SELECT player_id, game_id, minutes,
  CASE WHEN COUNT(minutes) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3 THEN quantile_cont(minutes, 0.5) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS prior_median FROM game_logs)
SELECT *, COALESCE(minutes < 0.4 * prior_median AND prior_median >= 12 AND NOT minutes < 5, false) AS anomaly FROM m"""))
def dnp_anomalies(spark, sf):
    return W.dnp_anomalies(game_logs(spark, sf))


@query("home_away_split", sql("game_logs", f"""l AS (SELECT player_id, game_id, game_date, start_time, LAG(CAST(points AS DOUBLE)) OVER ({PW}) AS x, LAG(CAST(is_home AS INTEGER)) OVER ({PW}) AS h FROM game_logs),
w AS (SELECT player_id, game_id, AVG(x) OVER f AS a, COUNT(x) OVER f AS n, SUM(CASE WHEN h = 1 THEN x END) OVER f AS hs, COUNT(CASE WHEN h = 1 THEN 1 END) OVER f AS hn,
  SUM(CASE WHEN h = 0 THEN x END) OVER f AS vs, COUNT(CASE WHEN h = 0 THEN 1 END) OVER f AS vn FROM l WINDOW f AS ({PW} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT player_id, game_id, COALESCE(CASE WHEN n >= 3 AND hn > 0 THEN hs / hn END, a, 0.0) AS home_avg_10, COALESCE(CASE WHEN n >= 3 AND vn > 0 THEN vs / vn END, a, 0.0) AS away_avg_10 FROM w"""))
def home_away_split(spark, sf):
    return W.home_away_split(game_logs(spark, sf))


@query("days_rest", sql("game_logs", f"""d AS (SELECT player_id, game_id, LEAST(GREATEST(COALESCE(date_diff('day', LAG(game_date) OVER ({PW}), game_date), 4), 0), 14) AS days_rest,
  ROW_NUMBER() OVER ({PW}) - 1 AS games_played, COALESCE(SUM(minutes) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS minutes_so_far FROM game_logs)
SELECT player_id, game_id, days_rest, days_rest <= 1 AS back_to_back, games_played, minutes_so_far FROM d"""))
def days_rest(spark, sf):
    return W.rest_and_counters(game_logs(spark, sf))


@query("minutes_floor", sql("game_logs", f"""SELECT player_id, game_id, COALESCE(AVG(CASE WHEN starter THEN 1.0 ELSE 0.0 END) OVER f, 0.0) AS starter_share,
  COALESCE(CASE WHEN COUNT(minutes) OVER f >= 3 THEN quantile_cont(minutes, 0.2) OVER f END, 0.0) AS minutes_floor
FROM game_logs WINDOW f AS ({PW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""))
def minutes_floor(spark, sf):
    return W.role_features(game_logs(spark, sf))


@query("opponent_allowed", sql("game_logs", """SELECT player_id, game_id, COALESCE(AVG(CAST(points AS DOUBLE)) OVER a, AVG(CAST(points AS DOUBLE)) OVER b, AVG(CAST(points AS DOUBLE)) OVER c, 0.0) AS allowed, AVG(CAST(points AS DOUBLE)) OVER c AS allowed_any_10
FROM game_logs WINDOW a AS (PARTITION BY player_id, opponent_team_id ORDER BY game_date, start_time, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
 b AS (PARTITION BY opponent_team_id, position ORDER BY game_date, start_time, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
 c AS (PARTITION BY opponent_team_id ORDER BY game_date, start_time, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""))
def opponent_allowed(spark, sf):
    return W.opponent_allowed(game_logs(spark, sf))


@query("hit_rate_10", sql("game_logs", f"""SELECT player_id, game_id, COALESCE(AVG(CASE WHEN minutes > 0 THEN CASE WHEN points > minutes / 4 THEN 1.0 ELSE 0.0 END END) OVER ({PW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.5) AS hit_rate_10 FROM game_logs"""))
def hit_rate_10(spark, sf):
    return W.hit_rate(game_logs(spark, sf))


@query("blended_pace", sql("game_logs", """t AS (SELECT team_id, game_id, opponent_team_id, game_date, start_time, CAST(SUM(pra) AS DOUBLE) AS pace FROM game_logs GROUP BY ALL),
p AS (SELECT team_id, game_id, COALESCE(AVG(pace) OVER (PARTITION BY team_id ORDER BY game_date, start_time, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.0) AS a,
  COALESCE(AVG(pace) OVER (PARTITION BY opponent_team_id ORDER BY game_date, start_time, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.0) AS b FROM t)
SELECT team_id, game_id, 0.45 * a + 0.45 * b + 0.10 * (a + b) / 4.8 AS blended_pace FROM p"""))
def blended_pace(spark, sf):
    return W.blended_pace(game_logs(spark, sf))


@query("profile_bucket", sql("game_logs", """p AS (SELECT player_id, AVG(minutes) AS m, MIN(position) AS position FROM game_logs GROUP BY player_id)
SELECT player_id, position, CAST(LEAST(floor(ROW_NUMBER() OVER (PARTITION BY position ORDER BY m, player_id) * 4.0 / COUNT(*) OVER (PARTITION BY position)), 3) AS BIGINT) AS bucket FROM p"""))
def profile_bucket(spark, sf):
    return W.profile_bucket(game_logs(spark, sf))


@query("trade_context", sql("game_logs", f"""a AS (SELECT *, opponent_team_id % 2 AS side, LAG(opponent_team_id % 2) OVER ({PW}) AS was FROM game_logs),
b AS (SELECT *, COALESCE(was <> side, false) AS changed FROM a), c AS (SELECT *, CAST(SUM(CAST(changed AS INTEGER)) OVER ({PW} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stint FROM b),
d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id, stint ORDER BY game_date, start_time, game_id) - 1 AS games_since FROM c)
SELECT player_id, game_id, changed, stint, games_since, stint > 0 AND games_since < 5 AS recent_change FROM d"""))
def trade_context(spark, sf):
    return W.trade_context(game_logs(spark, sf))


@query("return_sessions", sql("game_logs", f"""a AS (SELECT *, COALESCE(date_diff('day', LAG(game_date) OVER ({PW}), game_date) > 10, false) AS returned FROM game_logs),
b AS (SELECT *, CAST(SUM(CAST(returned AS INTEGER)) OVER ({PW} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a)
SELECT player_id, game_id, returned, session, ROW_NUMBER() OVER (PARTITION BY player_id, session ORDER BY game_date, start_time, game_id) AS game_in_session FROM b"""))
def return_sessions(spark, sf):
    return W.return_sessions(game_logs(spark, sf))


@query("date_islands", sql("game_logs", """d AS (SELECT DISTINCT team_id, game_date FROM game_logs), i AS (SELECT *, game_date - CAST(ROW_NUMBER() OVER (PARTITION BY team_id ORDER BY game_date) AS INTEGER) AS island FROM d)
SELECT team_id, MIN(game_date) AS first_day, MAX(game_date) AS last_day, COUNT(*) AS n_days FROM i GROUP BY team_id, island"""))
def date_islands(spark, sf):
    return W.date_islands(game_logs(spark, sf))


@query("surrogate_lines", sql("game_logs", """u AS (UNPIVOT (SELECT player_id, game_id, game_date, start_time, CAST(points AS DOUBLE) AS points, CAST(assists AS DOUBLE) AS assists, CAST(pra AS DOUBLE) AS pra FROM game_logs) ON points, assists, pra INTO NAME market VALUE actual),
l AS (SELECT *, CASE WHEN COUNT(actual) OVER f >= 5 THEN AVG(actual) OVER f END AS line FROM u WINDOW f AS (PARTITION BY player_id, market ORDER BY game_date, start_time, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT player_id, game_id, market, line, actual, actual > line AS over, actual = line AS push, year(game_date) - CASE WHEN month(game_date) >= 10 THEN 0 ELSE 1 END AS season FROM l WHERE line IS NOT NULL"""))
def surrogate_lines(spark, sf):
    return W.surrogate_lines(game_logs(spark, sf))


@query("trailing_baseline", sql("game_logs", """a AS (SELECT *, COALESCE(date_diff('day', LAG(game_date) OVER w, game_date) > 10, false) AS away FROM game_logs WINDOW w AS (PARTITION BY player_id, team_id ORDER BY game_date, start_time, game_id))
SELECT player_id, game_id, COALESCE(CASE WHEN COUNT(minutes) OVER f >= 10 THEN AVG(minutes) OVER f END, AVG(minutes) OVER u) AS baseline, away OR COALESCE(LAG(away) OVER w, false) AS excluded
FROM a WINDOW w AS (PARTITION BY player_id, team_id ORDER BY game_date, start_time, game_id), f AS (PARTITION BY player_id, team_id ORDER BY game_date, start_time, game_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING),
 u AS (PARTITION BY player_id, team_id ORDER BY game_date, start_time, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def trailing_baseline(spark, sf):
    return W.trailing_baseline(game_logs(spark, sf))


@query("stat_drop_guard", sql("game_logs", "SELECT player_id, game_id, minutes < 5 " + " ".join(
    f"OR COALESCE(CASE WHEN COUNT({s}) OVER f >= 2 THEN AVG({s}) OVER f END > 1 AND {s} < 0.5 * AVG({s}) OVER f, false)" for s in ("points", "rebounds", "assists", "threes", "turnovers"))
    + f" AS dropped FROM game_logs WINDOW f AS ({PW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"))
def stat_drop_guard(spark, sf):
    return W.stat_drop_guard(game_logs(spark, sf))
