"""Sources, sinks and streams: the tables are written as the files that a source takes, and read back by it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hardwood.functions import text as X
from hardwood.operators import frames
from hardwood.sources import files
from hardwood.sources.roles import box_scores, game_logs, quotes, sql, table
from hardwood.sources.tables import folder
from hardwood.streaming import live, risk

from .desk_queries import LIMITS, orders
from .registry import query, round_sql, rounded
from .window_queries import PW

SEASON = "year(game_date) - CASE WHEN month(game_date) >= 10 THEN 0 ELSE 1 END"


def seasons(spark, sf) -> str:
    path = folder(spark)
    files.write_seasons(game_logs(spark, sf).withColumn("season", X.season_of(F.col("game_date")).cast("long")), path)
    return path


@query("season_dataset", sql("game_logs", f"SELECT player_id, game_id, game_date, minutes, points, CAST({SEASON} AS BIGINT) AS season, 0.0::DOUBLE AS spread FROM game_logs WHERE minutes >= 5 AND game_date <= DATE '2000-06-30'"))
def season_dataset(spark, sf):
    """Partitioned by season, read up to a day, with a default for a column that it lacks."""
    d = files.read_seasons(spark, seasons(spark, sf), as_of="2000-06-30", defaults={"spread": 0.0})
    return d.select("player_id", "game_id", "game_date", "minutes", "points", F.col("season").cast("long").alias("season"), "spread")


@query("history_union", sql("game_logs", f"SELECT player_id, game_id, minutes, season FROM (SELECT player_id, game_id, minutes, CAST({SEASON} AS BIGINT) AS season, game_date FROM game_logs WHERE minutes >= 5) WHERE game_date <= DATE '1998-12-31' UNION ALL SELECT player_id, game_id, minutes, NULL FROM game_logs WHERE game_date > DATE '1997-12-31'"))
def history_union(spark, sf):
    """Stored seasons and live games; a game in both stays twice."""
    stored = files.read_seasons(spark, seasons(spark, sf), as_of="1998-12-31").select("player_id", "game_id", "minutes", F.col("season").cast("long").alias("season"))
    return files.history(stored, game_logs(spark, sf).where("game_date > date'1997-12-31'").select("player_id", "game_id", "minutes"))


@query("graded_csv", sql("quotes", "SELECT CAST(ts AS DATE) AS game_date, game_id, 'P ' || player_id AS player_name, market_key AS market, CAST(sportsbook_id AS VARCHAR) AS sportsbook, line_value, CAST(over_odds AS INTEGER) AS over_odds, CAST(under_odds AS INTEGER) AS under_odds, line_value + 1 AS actual FROM quotes WHERE snapshot_id % 17 <> 0"))
def graded_csv(spark, sf):
    """Graded props through CSV; lines that do not fit their type are told apart."""
    path = folder(spark)
    bad = F.col("snapshot_id") % 17 == 0
    q = quotes(spark, sf).select(F.to_date("ts").alias("game_date"), "game_id", F.concat(F.lit("P "), F.col("player_id")).alias("player_name"), F.col("market_key").alias("market"), F.col("sportsbook_id").alias("sportsbook"),
                                 F.when(bad, "n/a").otherwise(F.col("line_value").cast("string")).alias("line_value"), "over_odds", "under_odds", (F.col("line_value") + 1).alias("actual"))
    q.write.option("header", True).csv(path)
    return files.read_graded(spark, path)[0]


@query("props_json", sql("quotes", "SELECT game_id, CAST(player_id AS VARCHAR) AS player, market_key AS market, line_value AS line, CAST(over_odds AS INTEGER) AS over_odds, NULL::INTEGER AS under_odds FROM quotes"))
def props_json(spark, sf):
    """Nested files of games and their props; odds that are no whole number are null."""
    path = folder(spark)
    prop = F.struct(F.col("player_id").cast("string").alias("player"), F.col("market_key").alias("market"), F.col("line_value").alias("line"), F.col("over_odds").cast("string").alias("over_odds"), F.lit("even").alias("under_odds"))
    page = F.expr("snapshot_id div 50")  # a file's page holds the props of fifty snapshots
    d = quotes(spark, sf).groupBy(page.alias("page"), "game_id").agg(F.collect_list(prop).alias("props"))
    d.select(F.array(F.struct(F.col("game_id").alias("id"))).alias("games"), F.create_map(F.col("game_id").cast("string"), F.col("props")).alias("props_by_game")).write.json(path)
    return files.read_props(spark, path, lines=True)


def streamed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives over all input there is, written and read back."""
    spark, path, state = stream.sparkSession, folder(stream.sparkSession), folder(stream.sparkSession)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def arrivals(spark, sf) -> DataFrame:
    """The events as a stream of files, each fill sent twice."""
    path = folder(spark)
    e = table(spark, sf, "events").select(F.col("event_id").alias("fill_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("symbol"), "value")
    e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy").write.parquet(path)
    return spark.readStream.schema(e.schema).parquet(path)


@query("fills_once", "SELECT event_id AS fill_id, ts, CAST(user_id AS VARCHAR) AS symbol, value FROM events")
def fills_once(spark, sf):
    """A stream in which every fill comes twice gives each once."""
    return streamed(live.fills_once(arrivals(spark, sf), "3000 days")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_risk", "SELECT COUNT(*) AS orders FROM events WHERE ts <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR")
def stream_risk(spark, sf):
    """Orders that the stream has decided once the watermark, an hour behind the newest, has passed them."""
    path = folder(spark)
    o = orders(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    o.write.parquet(path)
    return streamed(risk.stream_decisions(spark.readStream.schema(o.schema).parquet(path), LIMITS)).agg(F.count(F.lit(1)).alias("orders"))


@query("parsed_fields", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 48 + (event_id % 60) / 60.0::DOUBLE WHEN event_id % 3 = 1 THEN value ELSE NULL END AS minutes, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS flag, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def parsed_fields(spark, sf):
    """Clock or plain minutes, flags of any spelling, and the JSON object in a text."""
    k = F.col("event_id")
    clock = F.when(k % 3 == 0, F.concat_ws(":", (k % 48).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"))).when(k % 3 == 1, F.col("value").cast("string")).otherwise("DNP")
    flag = F.element_at(F.array(*[F.lit(x) for x in ("Yes", " FALSE ", "1", "", "maybe")]), (k % 5 + 1).cast("int"))
    said = F.when(k % 2 == 0, F.concat(F.lit("Here: ```json\n"), F.col("props"), F.lit("\n``` done"))).otherwise(F.concat(F.lit("answer "), F.col("props")))
    return rounded(table(spark, sf, "events").select("event_id", X.clock_minutes(clock).alias("minutes"), X.flag(flag).alias("flag"), F.get_json_object(X.json_object_in(said), "$.k").cast("long").alias("k")))


@query("prior_fill", round_sql(sql("box_scores", f"""h AS (SELECT player_id, game_id, game_date, start_time, COALESCE(NULLIF(upper(left(trim(COALESCE(position, '')), 1)), ''), 'UNK') AS position_group, COALESCE(CAST(starter AS INTEGER), 0) AS starter_flag, AVG(CAST(points AS DOUBLE)) OVER w AS points_avg, AVG(minutes) OVER w AS minutes_avg, COUNT(*) OVER w AS games
  FROM box_scores WINDOW w AS ({PW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN games >= 5 THEN 'A' WHEN games >= 2 THEN 'C' ELSE 'D' END AS tier FROM h), n AS (SELECT * REPLACE (CASE WHEN game_id % 4 = 0 THEN NULL ELSE points_avg END AS points_avg) FROM t),
r AS (SELECT position_group, starter_flag, AVG(points_avg) AS p, AVG(minutes_avg) AS m FROM n GROUP BY ALL), q AS (SELECT position_group, AVG(points_avg) AS p, AVG(minutes_avg) AS m FROM n GROUP BY ALL), a AS (SELECT AVG(points_avg) AS p, AVG(minutes_avg) AS m FROM n)
SELECT player_id, game_id, tier, COALESCE(CASE tier WHEN 'D' THEN COALESCE(r.p, q.p, a.p, points_avg) WHEN 'C' THEN COALESCE(points_avg, q.p, a.p) ELSE points_avg END, 0) AS points_avg, COALESCE(CASE tier WHEN 'D' THEN COALESCE(r.m, q.m, a.m, minutes_avg) WHEN 'C' THEN COALESCE(minutes_avg, q.m, a.m) ELSE minutes_avg END, 0) AS minutes_avg
FROM n JOIN r ON r.position_group = n.position_group AND r.starter_flag = n.starter_flag JOIN q ON q.position_group = n.position_group, a"""), "points_avg minutes_avg"))
def prior_fill(spark, sf):
    """Features of players with little history filled by the priors of their role and position."""
    from hardwood.functions.rates import position_group
    from hardwood.operators import windows as W

    w = W.before(W.by("player_id"), 5)
    h = box_scores(spark, sf).select(F.col("player_id").alias("who"), "game_id", position_group(F.col("position")).alias("position_group"), F.coalesce(F.col("starter").cast("int"), F.lit(0)).alias("starter_flag"), F.avg(F.col("points").cast("double")).over(w).alias("points_avg"), F.avg("minutes").over(w).alias("minutes_avg"), F.count(F.lit(1)).over(w).alias("games"))
    h = h.withColumn("points_avg", F.when(F.col("game_id") % 4 != 0, F.col("points_avg")))
    # a game of a player is what has a tier here
    tiers = h.select(F.col("game_id").alias("player_id"), F.when(F.col("games") >= 5, "A").when(F.col("games") >= 2, "C").otherwise("D").alias("tier"))
    d = frames.fill_priors(h.withColumn("player_id", F.col("game_id")), h, ["points_avg", "minutes_avg"], tiers)
    return rounded(d.select(F.col("who").alias("player_id"), "game_id", "tier", "points_avg", "minutes_avg"))
