"""Role views: the engine's canonical tables over the star-schema parquet, as DataFrames and as SQL.

Each view exists twice with the same rows: a function ``(spark, sf_dir) -> DataFrame`` for the engine, and a
SQL text for comparison. ``sql(name, ...)`` strings the texts of the views a query uses into a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def game_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player game logs joined to games; one row per (player_id, game_id)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("minutes"), F.sum("l_linenumber").cast("long").alias("points"),
        F.count(F.lit(1)).alias("rebounds"), F.max("l_linenumber").cast("long").alias("assists"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long").alias("turnovers"),
        F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).cast("long").alias("threes"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    teams = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    g = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(teams, F.col("o_custkey") == F.col("c_custkey"))
    team = F.col("c_nationkey").cast("long")
    return g.select(
        F.col("o_custkey").alias("player_id"), F.col("o_orderkey").alias("game_id"), team.alias("team_id"),
        F.pmod(team + 1 + F.col("o_orderkey") % 24, F.lit(25)).alias("opponent_team_id"),
        F.to_date("o_orderdate").alias("game_date"), F.col("o_orderdate").alias("start_time"),
        "minutes", "points", "rebounds", "assists", "turnovers", "threes",
        (F.col("points") + F.col("rebounds") + F.col("assists")).alias("pra"),
        F.substring("o_orderpriority", 1, 1).alias("position"), F.col("o_orderstatus").alias("status"),
        (F.col("o_orderkey") % 2 == 0).alias("is_home"), (F.col("o_orderkey") % 3 == 0).alias("starter"))


def box_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game logs with attempts, fouls, possessions, usage and the market's total; some values are missing."""
    k = F.col("l_orderkey")
    more = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_suppkey") % 7).alias("field_goal_attempts"), F.sum(F.col("l_partkey") % 5).alias("free_throw_attempts"),
        F.count_if(F.col("l_partkey") % 3 == 0).alias("fouls"), F.when(k % 13 > 0, F.sum(F.col("l_suppkey") % 30)).alias("possessions"),
        F.when(k % 7 > 0, F.sum(F.col("l_linenumber") * 9 % 40).cast("double") / F.count(F.lit(1))).alias("usage_percentage"))
    g = game_logs(spark, sf_dir).join(more, F.col("game_id") == k).drop("l_orderkey")
    code = F.element_at(F.array(*[F.lit(x) for x in ("Guard", "f", " C", "")]), F.col("position").cast("int") % 5 + 1)
    return g.withColumns({"position": F.when(F.col("position") != "4", code), "total": F.when(F.col("game_id") % 6 > 0, (200 + F.col("game_id") % 60).cast("double"))})


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote snapshots; ``ts`` is unique."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("snapshot_id"), "ts", F.col("user_id").alias("player_id"), F.col("event_type").alias("market_key"),
        (k % 5).alias("sportsbook_id"), (k % 7).alias("game_id"), F.col("value").alias("line_value"),
        F.when(k % 7 == 0, None).when(k % 2 == 0, -(100 + k % 120)).otherwise(100 + k % 180).alias("over_odds"),
        F.when(k % 11 == 0, None).when(k % 3 == 0, 100 + k % 150).otherwise(-(100 + k % 140)).alias("under_odds"),
        F.col("props").alias("meta"))


def injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability reports of players."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        k.alias("report_id"), F.col("user_id").alias("player_id"), F.col("ts").alias("report_ts"),
        F.element_at(F.array(*[F.lit(s) for s in ("out", "doubtful", "questionable", "available")]), (k % 4 + 1).cast("int")).alias("status"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability forecasts with outcomes; one row per (player, game)."""
    g = game_logs(spark, sf_dir)
    k = F.col("game_id")
    return g.select("player_id", "game_id", "team_id", "game_date", F.element_at(F.array(F.lit("points"), F.lit("assists"), F.lit("threes")), (k % 3 + 1).cast("int")).alias("market"),
                    (F.pmod(k * 37 + F.col("player_id") * 11, F.lit(97)) / 100.0 + 0.01).alias("p"), F.when(F.col("points") > 12, 1).otherwise(0).alias("y"),
                    (F.pmod(k, F.lit(20)) + 4.5).alias("line"), F.col("points").cast("double").alias("actual"), "is_home")


def teammates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players numbered within their team from 0, with the size of the team."""
    w = Window.partitionBy("c_nationkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("team_id"), F.col("c_custkey").alias("player_id"),
                                                   (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability reports on a team's players for a game, up to four a game, from three days before to a day after its start."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(k.alias("report_id"), (k - k % 4).alias("game_id"), F.col("value").alias("expected_minutes"))
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), "o_custkey", "o_orderdate")
    g = g.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("team_id")), F.col("o_custkey") == F.col("c_custkey"))
    t = teammates(spark, sf_dir)
    # the place is known from the team's size before players are met, so that both columns are join keys and no team meets all its players
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("team_id")).agg(F.count(F.lit(1)).alias("n"))
    e = e.join(g, "game_id").join(F.broadcast(sizes), "team_id").withColumn("i", F.col("report_id") % F.col("n"))
    r = e.join(t.select("team_id", "i", "player_id"), ["team_id", "i"])
    k = F.col("report_id")
    words = F.array(*[F.lit(x) for x in ("out", "doubtful", "Questionable", "available", "Inactive")])
    return r.select("report_id", "game_id", "team_id", "player_id", (F.col("player_id") % 5 + 1).cast("string").alias("position"),
                    (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 97 - 72).cast("int"))).alias("report_ts"), F.element_at(words, (k % 5 + 1).cast("int")).alias("status"),
                    "expected_minutes", (k % 2 == 0).alias("projected_starter"), (k % 11 == 0).alias("official_inactive"))


VIEWS = {
    "game_logs": """game_logs AS (
  SELECT o.o_custkey AS player_id, o.o_orderkey AS game_id, CAST(c.c_nationkey AS BIGINT) AS team_id,
    (c.c_nationkey + 1 + o.o_orderkey % 24) % 25 AS opponent_team_id, CAST(o.o_orderdate AS DATE) AS game_date, o.o_orderdate AS start_time,
    SUM(l.l_quantity) AS minutes, CAST(SUM(l.l_linenumber) AS BIGINT) AS points, COUNT(*) AS rebounds, CAST(MAX(l.l_linenumber) AS BIGINT) AS assists,
    CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS turnovers, CAST(SUM(CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS threes,
    CAST(SUM(l.l_linenumber) + COUNT(*) + MAX(l.l_linenumber) AS BIGINT) AS pra, substr(o.o_orderpriority, 1, 1) AS position, o.o_orderstatus AS status,
    o.o_orderkey % 2 = 0 AS is_home, o.o_orderkey % 3 = 0 AS starter
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  GROUP BY o.o_custkey, o.o_orderkey, c.c_nationkey, o.o_orderdate, o.o_orderpriority, o.o_orderstatus)""",
    "box_scores": """box_scores AS (
  SELECT g.* EXCLUDE (position), CASE WHEN position <> '4' THEN (['Guard', 'f', ' C', ''])[CAST(position AS INTEGER) % 5 + 1] END AS position, field_goal_attempts, free_throw_attempts, fouls, possessions, usage_percentage,
    CASE WHEN g.game_id % 6 > 0 THEN CAST(200 + g.game_id % 60 AS DOUBLE) END AS total
  FROM game_logs g JOIN (SELECT l_orderkey, CAST(SUM(l_suppkey % 7) AS BIGINT) AS field_goal_attempts, CAST(SUM(l_partkey % 5) AS BIGINT) AS free_throw_attempts, COUNT(*) FILTER (WHERE l_partkey % 3 = 0) AS fouls,
    CASE WHEN l_orderkey % 13 > 0 THEN CAST(SUM(l_suppkey % 30) AS BIGINT) END AS possessions, CASE WHEN l_orderkey % 7 > 0 THEN CAST(SUM(l_linenumber * 9 % 40) AS DOUBLE) / COUNT(*) END AS usage_percentage FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = g.game_id)""",
    "quotes": """quotes AS (
  SELECT event_id AS snapshot_id, ts, user_id AS player_id, event_type AS market_key, event_id % 5 AS sportsbook_id, event_id % 7 AS game_id, value AS line_value,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN -(100 + event_id % 120) ELSE 100 + event_id % 180 END AS over_odds,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 100 + event_id % 150 ELSE -(100 + event_id % 140) END AS under_odds, props AS meta
  FROM events)""",
    "injuries": """injuries AS (
  SELECT event_id AS report_id, user_id AS player_id, ts AS report_ts, (['out','doubtful','questionable','available'])[event_id % 4 + 1] AS status
  FROM events WHERE event_type = 'error')""",
    "predictions": """predictions AS (
  SELECT player_id, game_id, team_id, game_date, (['points','assists','threes'])[game_id % 3 + 1] AS market,
    CAST((game_id * 37 + player_id * 11) % 97 AS DOUBLE) / 100.0 + 0.01 AS p, CASE WHEN points > 12 THEN 1 ELSE 0 END AS y,
    CAST(game_id % 20 AS DOUBLE) + 4.5 AS line, CAST(points AS DOUBLE) AS actual, is_home
  FROM game_logs)""",
    "teammates": """teammates AS (SELECT CAST(c_nationkey AS BIGINT) AS team_id, c_custkey AS player_id, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""",
    "reports": """reports AS (
  SELECT e.event_id AS report_id, o.o_orderkey AS game_id, t.team_id, t.player_id, CAST(t.player_id % 5 + 1 AS VARCHAR) AS position, o.o_orderdate + to_hours(CAST(e.event_id % 97 - 72 AS INTEGER)) AS report_ts,
    (['out','doubtful','Questionable','available','Inactive'])[event_id % 5 + 1] AS status, e.value AS expected_minutes, e.event_id % 2 = 0 AS projected_starter, e.event_id % 11 = 0 AS official_inactive
  FROM events e JOIN orders o ON o.o_orderkey = e.event_id - e.event_id % 4 JOIN customer c ON c.c_custkey = o.o_custkey JOIN teammates t ON t.team_id = c.c_nationkey AND t.i = e.event_id % t.n)""",
}
NEEDS = {"predictions": ("game_logs",), "box_scores": ("game_logs",), "reports": ("teammates",)}


def sql(views: str, body: str) -> str:
    """``body`` after a WITH clause of the named views; further CTEs may follow in ``body`` after a comma."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in (*NEEDS.get(v, ()), v) if n not in names]
    body = body.strip()
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + ("\n" if body.upper().startswith("SELECT") else ",\n") + body
