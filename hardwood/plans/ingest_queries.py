"""Status changes, aliases, replaced runs, ticker frames and fills; over the role views."""

from pyspark.sql import functions as F

from hardwood.operators import ingest as I
from hardwood.sources import files
from hardwood.sources.roles import table
from hardwood.streaming import live

from .registry import query


@query("game_status", """WITH g AS (SELECT o_orderkey AS game_id, CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'P' THEN 'superseded' ELSE 'final' END AS status, o_orderkey % 3 AS k FROM orders)
SELECT game_id, status, CASE WHEN status = 'scheduled' AND k <> 0 THEN 'superseded' WHEN status = 'superseded' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = game_id AND l_returnflag = 'R') THEN 'final' ELSE status END AS new_status FROM g""")
def game_status(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "scheduled").when(F.col("o_orderstatus") == "P", "superseded").otherwise("final")
    g = table(spark, sf, "orders").select(F.col("o_orderkey").alias("game_id"), status.alias("status"))
    return I.game_status(g, g.where("game_id % 3 = 0"), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("game_id")))


ALIAS = "SELECT user_id AS entity_id, event_type AS source, 'a' || (event_id % 17) AS alias FROM events"


@query("alias_merge", f"""WITH x AS ({ALIAS}), p AS (SELECT entity_id, source, string_agg(DISTINCT alias, ',' ORDER BY alias) AS a FROM x GROUP BY ALL)
SELECT entity_id, (SELECT string_agg(DISTINCT alias, ',' ORDER BY alias) FROM x WHERE x.entity_id = p.entity_id) AS aliases, string_agg(source || '=' || a, ';' ORDER BY source) AS by_source FROM p GROUP BY entity_id""")
def alias_merge(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("source"), F.concat(F.lit("a"), F.col("event_id") % 17).alias("alias"))
    s = I.alias_sets(e)
    return s.select("entity_id", F.array_join("aliases", ",").alias("aliases"), F.array_join(F.transform("by_source", lambda x: F.concat(x["source"], F.lit("="), F.array_join(x["a"], ","))), ";").alias("by_source"))


@query("replace_run", """WITH p AS (SELECT o_orderkey % 4 AS run_id, o_orderkey % 50 AS game_id, o_custkey AS player_id, o_totalprice AS mean FROM orders), n AS (SELECT run_id, game_id, player_id, mean + 1 AS mean FROM p WHERE run_id = 2 AND game_id < 30 AND player_id % 2 = 0)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.run_id = p.run_id AND n.game_id = p.game_id) UNION ALL SELECT * FROM n""")
def replace_run(spark, sf):
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select((k % 4).alias("run_id"), (k % 50).alias("game_id"), F.col("o_custkey").alias("player_id"), F.col("o_totalprice").alias("mean"))
    new = p.where("run_id = 2 and game_id < 30 and player_id % 2 = 0").withColumn("mean", F.col("mean") + 1)
    return I.replace_run(p, new)


FRAME = """'{"type": "' || CASE WHEN event_id % 9 = 0 THEN 'status' ELSE 'ticker' END || '", "seq": ' || event_id || ', "msg": {"market_ticker": "' || CASE WHEN event_id % 13 = 0 THEN '' ELSE 'T' || user_id END || '", "yes_bid_dollars": "' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST((event_id % 80) AS VARCHAR) || '.25' END || '", "yes_ask_dollars": "' || CAST((event_id % 90 + 1) AS VARCHAR) || '.5"}}'"""


@query("ticker_frames", """SELECT event_id AS seq, 'T' || user_id AS ticker, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 80 + 0.25 END::DOUBLE AS yes_bid, (event_id % 90 + 1.5)::DOUBLE AS yes_ask,
 round(CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 90 + 1.5) - (event_id % 80 + 0.25) END, 4)::DOUBLE AS spread FROM events WHERE event_id % 9 <> 0 AND event_id % 13 <> 0""")
def ticker_frames(spark, sf):
    e = table(spark, sf, "events").select(F.expr(FRAME.replace("VARCHAR", "STRING")).alias("value"))
    return live.frames(e).select("seq", "ticker", "yes_bid", "yes_ask", "spread")


@query("exchange_fills", """SELECT 'f' || event_id AS fill_id, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side, (event_id % 5)::DOUBLE AS count, CASE WHEN event_id % 3 = 0 THEN round((event_id % 99 + 1) / 100.0::DOUBLE, 4) ELSE round((event_id % 99 + 1) / 128.0::DOUBLE, 4) END AS price FROM events WHERE event_id % 5 > 0""")
def exchange_fills(spark, sf):
    k = F.col("event_id")
    price = F.when(k % 3 != 0, ((k % 99 + 1) / 128.0).cast("string"))
    cents = F.when(k % 3 == 0, (k % 99 + 1).cast("string"))
    yes = k % 2 == 0
    fill = F.struct(F.concat(F.lit("f"), k).alias("fill_id"), F.when(yes, "YES").otherwise("No").alias("side"), (k % 5).cast("string").alias("count"), F.when(yes, price).alias("yes_price_dollars"), F.when(~yes, price).alias("no_price_dollars"),
                    F.when(yes, cents).alias("yes_price"), F.when(~yes, cents).alias("no_price"))
    e = table(spark, sf, "events").select(F.to_json(F.struct(F.array(fill).alias("fills"))).alias("payload"))
    return e.select(F.inline(files.fills_in(F.col("payload")))).select("fill_id", "side", "count", "price")
