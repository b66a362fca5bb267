"""Streams over files with availableNow against the same rows in batch."""

from hardwood.streaming import live
from pyspark.sql import functions as F


def run(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_frames_book_and_fills(spark, tmp_path):
    frame = lambda s, t, ask, kind="ticker": f'{{"type": "{kind}", "seq": {s}, "msg": {{"market_ticker": "{t}", "yes_bid_dollars": "0.40", "yes_ask_dollars": {ask}}}}}'
    lines = [frame(1, "A", '"0.45"'), frame(2, "A", '"0.50"'), frame(3, "B", '"0.61"'), frame(4, "", '"0.1"'), frame(5, "A", '"x"'), frame(6, "A", '"0.55"', "status"), "no json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    raw = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    rows = sorted(run(spark, live.frames(raw), "frames", tmp_path), key=lambda r: r.seq)
    assert [(r.seq, r.ticker, r.yes_ask, r.spread) for r in rows] == [(1, "A", 0.45, 0.05), (2, "A", 0.5, 0.1), (3, "B", 0.61, 0.21), (5, "A", None, None)]
    book = {(r.seq): (r.before, r.after) for r in run(spark, live.book_changes(live.frames(raw)), "book", tmp_path)}
    assert book == {1: (None, 0.45), 2: (0.45, 0.5), 3: (None, 0.61), 5: (0.5, None)}
    fills = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:05:00")], "fill_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    fills.write.parquet(str(tmp_path / "fills"))
    once = run(spark, live.fills_once(spark.readStream.schema(fills.schema).parquet(str(tmp_path / "fills"))), "fills", tmp_path)
    assert sorted(r.fill_id for r in once) == [1, 2]
    events = spark.createDataFrame([(i, f"2024-01-01 0{i}:00:00", "error" if i % 2 else "view", float(i)) for i in range(8)], "id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    health = run(spark, live.windowed_health(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))), "health", tmp_path, "complete")
    assert sorted((r.n, r.errors, r.mean_value) for r in health) == [(2, 1, 6.5), (6, 3, 2.5)]


def test_files(spark, tmp_path):
    from hardwood.sources import files

    games = spark.createDataFrame([(1, "2023-24", "2023-11-01", 30.0), (2, "2024-25", "2024-11-01", 4.0), (3, "2024-25", "2024-12-01", 20.0)], "game_id long, season string, game_date string, minutes double").withColumn("game_date", F.to_date("game_date"))
    files.write_seasons(games, str(tmp_path / "s"))
    files.write_seasons(games.where("game_id = 3"), str(tmp_path / "s"))
    got = files.read_seasons(spark, str(tmp_path / "s"), defaults={"spread": 0.0, "minutes": 1.0})
    assert sorted((r.game_id, r.season, r.spread) for r in got.collect()) == [(1, "2023-24", 0.0), (3, "2024-25", 0.0)]
    assert [r.game_id for r in files.read_seasons(spark, str(tmp_path / "s"), as_of="2024-01-01").collect()] == [1]
    assert files.history(games, got).count() == 5
    (tmp_path / "g.csv").write_text("game_date,game_id,player_name,market,sportsbook,line_value,over_odds,under_odds,actual\n2024-01-01,1,A B,points,x,20.5,-110,-110,22\n2024-01-01,x,A,points,x,bad,-110,-110,\n")
    good, bad = files.read_graded(spark, str(tmp_path / "g.csv"))
    assert [(r.player_name, r.line_value) for r in good.collect()] == [("A B", 20.5)] and len(bad.collect()) == 1
    (tmp_path / "p.json").write_text('{"games": [{"id": 7}], "props_by_game": {"7": [{"player": "A", "market": "points", "line": 1.5, "over_odds": "-110", "under_odds": "n/a"}]}}')
    assert [tuple(r) for r in files.read_props(spark, str(tmp_path / "p.json")).collect()] == [(7, "A", "points", 1.5, -110, None)]


def test_availability_looks_neither_ahead_nor_at_oneself(spark):
    from hardwood.operators import availability as A

    t = lambda x: F.to_timestamp_ntz(F.lit(x))
    games = spark.createDataFrame([(1, 10, 5, "1", 20, 30.0, 9, 2)], "player_id long, game_id long, team_id long, position string, points long, minutes double, field_goal_attempts long, free_throw_attempts long").withColumn("start_time", t("2024-01-10 20:00:00"))
    rows = [(1, 2, "out", "2024-01-10 18:00:00"), (2, 3, "out", "2024-01-10 19:00:00"), (3, 1, "out", "2024-01-10 12:00:00"), (4, 4, "Doubtful", "2023-12-01 00:00:00"), (5, 1, "doubtful", "2024-01-11 00:00:00")]
    reports = spark.createDataFrame([(*r[:3], r[3]) for r in rows], "report_id long, player_id long, status string, at string").select(
        "report_id", F.lit(10).cast("long").alias("game_id"), F.lit(5).cast("long").alias("team_id"), "player_id", "status", F.lit("1").alias("position"), F.to_timestamp_ntz("at").alias("report_ts"),
        F.lit(False).alias("official_inactive"), F.lit(30.0).alias("expected_minutes"), F.lit(True).alias("projected_starter"))
    a = A.availability(games, reports).first()
    assert (a.team_out_count, a.team_doubtful_count, a.same_position_out_count, a.projected_rotation_players) == (1, 1, 1, 3)
    assert A.injury_flag(games, reports).first().injury_return_flag is True
    assert A.injury_flag(games, reports.where("report_id = 5")).first().injury_return_flag is False
    assert A.injury_flag(games, reports.where("player_id = 1").withColumn("report_ts", t("2023-12-01 00:00:00"))).first().injury_return_flag is False
