"""Scans, ingest, targets and monitors over the role views."""

from pyspark.sql import functions as F

from hardwood.functions.odds import implied
from hardwood.operators import metrics as M
from hardwood.operators import monitor
from hardwood.operators import windows as W
from hardwood.sources.roles import game_logs, predictions, quotes, reports, sql, table

from .registry import query, round_sql, rounded
from .trading_queries import FILLS, fills
from .window_queries import PW

IMPLIED = "CASE WHEN {0} > 0 THEN 100.0::DOUBLE / ({0} + 100) WHEN {0} < 0 THEN -{0} / (100.0::DOUBLE - {0}) END"


@query("odds_snapshot_scan", round_sql(sql("quotes", f"""SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, q.player_id, market_key, sportsbook_id, snapshot_id, line_value, {IMPLIED.format('over_odds')} AS over_p, {IMPLIED.format('under_odds')} AS under_p
FROM quotes q JOIN orders ON o_orderkey = snapshot_id - snapshot_id % 4 WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '2000-06-30' AND json_valid(meta) AND TRY_CAST(json_extract_string(meta, '$.k') AS BIGINT) >= 10"""), "line_value over_p under_p"))
def odds_snapshot_scan(spark, sf):
    """Snapshots of games that count, up to a day, whose meta marks them usable, with the probabilities that their odds imply."""
    g = table(spark, sf, "orders").where("o_orderstatus <> 'P' and o_orderdate <= timestamp_ntz'2000-06-30 00:00:00'").select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"))
    q = quotes(spark, sf).where(F.get_json_object("meta", "$.k").try_cast("long") >= 10).withColumn("game_id", F.col("snapshot_id") - F.col("snapshot_id") % 4)
    return rounded(q.join(g, "game_id").select("game_id", "game_date", "player_id", "market_key", "sportsbook_id", "snapshot_id", "line_value", implied(F.col("over_odds")).alias("over_p"), implied(F.col("under_odds")).alias("under_p")))


def payloads(spark, sf):
    """Each quote as two payloads, the later one with other odds; some players and games are unknown."""
    k = F.col("snapshot_id")
    q = quotes(spark, sf).select("ts", (k - k % 4).alias("game_id"), "sportsbook_id", F.when(k % 19 == 0, -1).otherwise(F.col("player_id")).alias("player_id"), "market_key", "line_value", "over_odds", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return q.withColumn("over_odds", F.col("over_odds") + F.col("seq"))


@query("snapshot_ingest", sql("quotes", """p AS (SELECT ts, snapshot_id - snapshot_id % 4 AS game_id, sportsbook_id, CASE WHEN snapshot_id % 19 = 0 THEN -1 ELSE player_id END AS player_id, market_key, line_value, over_odds + 1 AS over_odds, snapshot_id FROM quotes),
n AS (SELECT * FROM p WHERE player_id IN (SELECT c_custkey FROM customer) AND game_id IN (SELECT o_orderkey FROM orders)), o AS (SELECT ts, snapshot_id - snapshot_id % 4 AS game_id, sportsbook_id, player_id, market_key, line_value, -1 AS over_odds, snapshot_id FROM quotes WHERE line_value > 10)
SELECT ts, game_id, sportsbook_id, player_id, market_key, line_value, CAST(over_odds AS BIGINT) AS over_odds FROM n UNION ALL SELECT ts, game_id, sportsbook_id, player_id, market_key, line_value, CAST(over_odds AS BIGINT) FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.snapshot_id = o.snapshot_id AND n.player_id = o.player_id)"""))
def snapshot_ingest(spark, sf):
    k = F.col("snapshot_id")
    old = quotes(spark, sf).where("line_value > 10").select("ts", (k - k % 4).alias("game_id"), "sportsbook_id", "player_id", "market_key", "line_value", F.lit(-1).cast("long").alias("over_odds"))
    keys = ["ts", "game_id", "sportsbook_id", "player_id", "market_key", "line_value"]
    return monitor.ingest(old, payloads(spark, sf), keys, {"player_id": table(spark, sf, "customer").select("c_custkey"), "game_id": table(spark, sf, "orders").select("o_orderkey")}, "seq")


@query("injury_ingest", sql("reports", """p AS (SELECT game_id, CASE WHEN report_id % 13 = 0 THEN -5 ELSE player_id END AS player_id, status, report_ts, report_id FROM reports), n AS (SELECT * FROM p WHERE player_id IN (SELECT c_custkey FROM customer) QUALIFY ROW_NUMBER() OVER (PARTITION BY game_id, player_id ORDER BY report_ts DESC, report_id DESC) = 1)
SELECT game_id, player_id, status FROM n"""))
def injury_ingest(spark, sf):
    p = reports(spark, sf).select("game_id", F.when(F.col("report_id") % 13 == 0, -5).otherwise(F.col("player_id")).alias("player_id"), "status", F.struct("report_ts", "report_id").alias("seq"))
    return monitor.ingest(p.select("game_id", "player_id", "status").where("false"), p, ["game_id", "player_id"], {"player_id": table(spark, sf, "customer").select("c_custkey")}, "seq")


@query("target_markets", sql("quotes", """t AS (SELECT player_id * 10 + dense_rank() OVER (ORDER BY market_key) AS target_id, player_id, market_key, floor(avg(line_value)) AS line, MIN(snapshot_id) AS s FROM quotes GROUP BY player_id, market_key),
m AS (SELECT snapshot_id AS market_id, 'player' || player_id || ' ' || market_key || ' over' AS text, floor(line_value) AS line, 'ev' || game_id AS event FROM quotes),
w AS (SELECT t.target_id, market_id, 40 + 25 + 40 + CASE WHEN m.event = 'ev' || (t.s % 7) THEN 20 ELSE 0 END AS score FROM t JOIN m ON abs(m.line - t.line) < 0.01 AND contains(m.text, 'player' || t.player_id) AND contains(m.text, t.market_key)),
b AS (SELECT * FROM w QUALIFY ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY score DESC, market_id) = 1)
SELECT t.target_id, market_id, COALESCE(score, 0) AS score, score IS NOT NULL AS matched FROM t LEFT JOIN b USING (target_id)"""))
def target_markets(spark, sf):
    q = quotes(spark, sf)
    from pyspark.sql import Window

    kinds = q.select("market_key").distinct().withColumn("kind", F.dense_rank().over(Window.orderBy("market_key")))  # one row a market
    # lines are added up in order of the snapshots: how a table is split must not decide on which side of a whole line a mean falls
    w = Window.partitionBy("player_id", "market_key").orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    so_far = q.select("player_id", "market_key", "snapshot_id", "line_value", F.sum("line_value").over(w).alias("sum"))
    line = F.floor(F.max_by("sum", "snapshot_id") / F.nullif(F.count("line_value"), F.lit(0))).cast("double")
    t = so_far.groupBy("player_id", "market_key").agg(line.alias("line"), F.min("snapshot_id").alias("s")).join(F.broadcast(kinds), "market_key")
    t = t.select((F.col("player_id") * 10 + F.col("kind")).alias("target_id"), F.array(F.concat(F.lit("Player"), F.col("player_id"))).alias("title_terms"), F.array().cast("array<string>").alias("player_terms"), F.array("market_key").alias("stat_terms"), F.array("line").alias("lines"), F.concat(F.lit("EV"), F.col("s") % 7).alias("hint"))
    m = q.select(F.col("snapshot_id").alias("market_id"), F.concat_ws(" ", F.concat(F.lit("player"), F.col("player_id")), "market_key", F.lit("over")).alias("text"), F.array(F.floor("line_value").cast("double")).alias("lines"), F.concat(F.lit("ev"), F.col("game_id")).alias("event"))
    return monitor.score_targets(t, m, 100).select("target_id", "market_id", "score", F.col("market_id").isNotNull().alias("matched"))


@query("pnl_monitor", round_sql("WITH " + FILLS + """, p AS (SELECT symbol, SUM(CASE WHEN side = 'buy' THEN stake ELSE 0 END) AS bought, SUM(CASE WHEN side = 'buy' THEN stake * price ELSE 0 END) AS cost FROM fills GROUP BY symbol),
q AS (SELECT CAST(user_id AS VARCHAR) AS symbol, arg_max((event_id % 97 + 1) / 100.0::DOUBLE, struct_pack(a := ts, b := event_id)) AS mark FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY ALL)
SELECT COUNT(*) AS positions, COUNT(mark) AS marked, SUM(cost) AS cost, SUM(bought * mark - cost) AS unrealized, SUM(bought * mark - cost) / 5000.0::DOUBLE AS progress FROM p LEFT JOIN q USING (symbol) WHERE bought > 0""", "cost unrealized progress"))
def pnl_monitor(spark, sf):
    """Open positions at their newest mark; symbols without one count as open but give no profit."""
    buy = F.col("side") == "buy"
    p = fills(spark, sf).groupBy("symbol").agg(F.sum(F.when(buy, F.col("stake")).otherwise(0.0)).alias("bought"), F.sum(F.when(buy, F.col("stake") * F.col("price")).otherwise(0.0)).alias("cost")).where("bought > 0")
    q = table(spark, sf, "events").where("event_type not in ('view', 'click', 'purchase')").groupBy(F.col("user_id").cast("string").alias("symbol")).agg(F.max_by((F.col("event_id") % 97 + 1) / 100.0, F.struct("ts", "event_id")).alias("mark"))
    gain = F.col("bought") * F.col("mark") - F.col("cost")
    return rounded(p.join(q, "symbol", "left").agg(F.count(F.lit(1)).alias("positions"), F.count("mark").alias("marked"), F.sum("cost").alias("cost"), F.sum(gain).alias("unrealized"), (F.sum(gain) / 5000.0).alias("progress")))


@query("policy_blockers", sql("predictions", """z AS (SELECT MAX(game_date) - 30 AS board FROM predictions)
SELECT player_id, game_id, concat_ws(',', CASE WHEN (['ready', 'watch', '', 'void'])[game_id % 4 + 1] <> 'ready' THEN 'candidate_status=' || CASE WHEN game_id % 4 = 2 THEN 'missing' ELSE (['ready', 'watch', '', 'void'])[game_id % 4 + 1] END END, CASE WHEN market = 'threes' THEN 'blocked_market_key' END,
 CASE WHEN game_date < board THEN 'game_already_played' WHEN game_date <> board THEN 'not_same_day' END, CASE WHEN p < 0.55 THEN 'min_model_prob' END, CASE WHEN game_id % 10 < 4 THEN 'min_confidence' END, CASE WHEN game_id % 7 = 0 OR game_id * 3 % 500 < 100 THEN 'min_edge_bps' END) AS blockers FROM predictions, z"""))
def policy_blockers(spark, sf):
    """Names of the rules of a policy that a candidate breaks, in order."""
    k = F.col("game_id")
    d = predictions(spark, sf)
    d = d.crossJoin(F.broadcast(d.agg(F.date_sub(F.max("game_date"), 30).alias("board"))))
    status = F.element_at(F.array(*[F.lit(x) for x in ("ready", "watch", "", "void")]), (k % 4 + 1).cast("int"))
    edge = F.when(k % 7 != 0, k * 3 % 500)
    rules = [F.when(status != "ready", F.concat(F.lit("candidate_status="), F.coalesce(F.nullif(status, F.lit("")), F.lit("missing")))), F.when(F.col("market") == "threes", "blocked_market_key"),
             F.when(F.col("game_date") < F.col("board"), "game_already_played").when(F.col("game_date") != F.col("board"), "not_same_day"), F.when(F.col("p").isNull() | (F.col("p") < 0.55), "min_model_prob"), F.when(k % 10 < 4, "min_confidence"), F.when(edge.isNull() | (edge < 100), "min_edge_bps")]
    return d.select("player_id", "game_id", F.array_join(F.array_compact(F.array(*rules)), ",").alias("blockers"))


ECE = """b AS (SELECT market, yr, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, AVG(p) AS mp, AVG(y) AS hy, COUNT(*) AS n FROM (SELECT *, year(game_date) AS yr FROM predictions) GROUP BY ALL), e AS (SELECT market, yr, SUM(abs(hy - mp) * n) / SUM(n) AS ece, SUM(n) AS n FROM b GROUP BY ALL)"""


def yearly(spark, sf):
    return M.ece(predictions(spark, sf).withColumn("yr", F.year("game_date").cast("long")), M.left_closed(F.col("p")), "market", "yr")


@query("overfit_risk", round_sql(sql("predictions", ECE + """, l AS (SELECT market AS signal, least(greatest(ece / 0.12, 0), 1) AS score FROM e WHERE yr = (SELECT MAX(yr) FROM e)), d AS (SELECT SUM(CASE WHEN yr = (SELECT MAX(yr) FROM e) THEN n ELSE 0 END)::DOUBLE / SUM(n) AS ratio FROM e),
s AS (SELECT * FROM l UNION ALL SELECT 'sample_sufficiency', 1 - least(greatest(ratio / 0.4, 0), 1) FROM d WHERE ratio < 0.4), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, signal) AS k FROM s) SELECT COUNT(*) AS signals, AVG(score) FILTER (WHERE k <= 5) AS risk, MAX(score) AS worst FROM r"""), "risk worst"))
def overfit_risk(spark, sf):
    """Mean of the five worst signals: each market's latest calibration error, and how much of the sample is recent."""
    e = yearly(spark, sf)
    last = e.agg(F.max("yr").alias("last"))
    e = e.crossJoin(F.broadcast(last))
    ratio = e.agg((F.sum(F.when(F.col("yr") == F.col("last"), F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))
    s = monitor.overfit_signals(e.where("yr = last"), ratio)
    top = F.slice(F.sort_array(F.collect_list("score"), False), 1, 5)  # a signal a market
    return rounded(s.agg(F.count(F.lit(1)).alias("signals"), F.aggregate(top, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(top)).alias("risk"), F.max("score").alias("worst")))


@query("release_deltas", round_sql(sql("predictions", ECE + """, r AS (SELECT market, yr, ece, LAG(ece) OVER (PARTITION BY market ORDER BY yr) AS before, ROW_NUMBER() OVER (PARTITION BY market ORDER BY yr DESC) AS k FROM e)
SELECT market, yr, ece, before, ece - before AS delta, CASE WHEN before IS NULL THEN 'first' WHEN ece - before > 0.02 THEN 'regressed' WHEN ece - before < -0.02 THEN 'improved' ELSE 'stable' END AS status FROM r WHERE k = 1"""), "ece before delta"))
def release_deltas(spark, sf):
    """Each market's newest calibration error against the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("market").orderBy("yr")  # a market's years
    d = yearly(spark, sf).withColumns({"before": F.lag("ece").over(w), "next": F.lead("yr").over(w)}).where("next is null").withColumn("delta", F.col("ece") - F.col("before"))
    return rounded(d.select("market", "yr", "ece", "before", "delta", F.when(F.col("before").isNull(), "first").when(F.col("delta") > 0.02, "regressed").when(F.col("delta") < -0.02, "improved").otherwise("stable").alias("status")))


@query("row_qa", sql("predictions", """SELECT player_id, game_id, CASE WHEN abs(actual - line) <= 1e-6 THEN 'push' WHEN actual > line THEN 'over' ELSE 'under' END AS hit, concat_ws(',', CASE WHEN CASE WHEN abs(actual - line) <= 1e-6 THEN 'push' WHEN actual > line THEN 'over' ELSE 'under' END <> (['over', 'under', 'push'])[game_id % 3 + 1] THEN 'hit_mismatch' END,
 CASE WHEN p < 0.02 OR p > 0.95 THEN 'extreme_probability' END, CASE WHEN line * 2 <> floor(line * 2) THEN 'odd_line' END) AS issues FROM predictions"""))
def row_qa(spark, sf):
    """The outcome worked out again, and what is wrong with a row."""
    hit = monitor.hit_flags(F.col("actual"), F.col("line"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("over", "under", "push")]), (F.col("game_id") % 3 + 1).cast("int"))
    issues = F.array_compact(F.array(F.when(hit != said, "hit_mismatch"), F.when((F.col("p") < 0.02) | (F.col("p") > 0.95), "extreme_probability"), F.when(F.col("line") * 2 != F.floor(F.col("line") * 2), "odd_line")))
    return predictions(spark, sf).select("player_id", "game_id", hit.alias("hit"), F.array_join(issues, ",").alias("issues"))


@query("quote_ages", sql("quotes", """z AS (SELECT MAX(ts) AS now FROM quotes), a AS (SELECT player_id, market_key, MAX(ts) AS newest, any_value(now) AS now FROM quotes, z GROUP BY ALL), m AS (SELECT *, CAST(floor(epoch_us(now - newest) / 60000000) AS BIGINT) AS m FROM a)
SELECT player_id, market_key, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ' || (m % 60) || 'm ago' ELSE (m // 1440) || 'd ' || (m // 60 % 24) || 'h ago' END AS age FROM m"""))
def quote_ages(spark, sf):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    q = quotes(spark, sf)
    a = q.groupBy("player_id", "market_key").agg(F.max("ts").alias("newest")).crossJoin(F.broadcast(q.agg(F.max("ts").alias("now"))))
    return a.select("player_id", "market_key", monitor.relative_age((micros("now") - micros("newest")) / 1e6).alias("age"))


@query("paired_modes", round_sql(sql("game_logs", f"""m AS (SELECT player_id, game_id, position, CAST(points AS DOUBLE) AS actual, AVG(CAST(points AS DOUBLE)) OVER ({PW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS off, AVG(CAST(points AS DOUBLE)) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ful FROM game_logs)
SELECT position, COUNT(*) AS n, sqrt(AVG((actual - off) ** 2)) AS rmse_off, sqrt(AVG((actual - ful) ** 2)) AS rmse_full, AVG(CASE WHEN abs(actual - ful) < abs(actual - off) THEN 1.0 ELSE 0.0 END) AS full_nearer FROM m WHERE off IS NOT NULL AND ful IS NOT NULL GROUP BY position"""), "rmse_off rmse_full full_nearer"))
def paired_modes(spark, sf):
    """Two runs of forecasts met by game and player, and which lies nearer."""
    w, y = W.by("player_id"), F.col("points").cast("double")
    g = game_logs(spark, sf)
    off = g.select("player_id", "game_id", "position", y.alias("actual"), F.avg(y).over(W.before(w, 5)).alias("off")).where("off is not null")
    full = g.select("player_id", "game_id", F.avg(y).over(W.before(w)).alias("full")).where("full is not null")
    e = lambda c: F.col("actual") - F.col(c)
    return rounded(off.join(full, ["player_id", "game_id"]).groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e("off") * e("off"))).alias("rmse_off"), F.sqrt(F.avg(e("full") * e("full"))).alias("rmse_full"), F.avg(F.when(F.abs(e("full")) < F.abs(e("off")), 1.0).otherwise(0.0)).alias("full_nearer")))
