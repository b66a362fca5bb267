"""Orders against limits: the stream decides as the batch does."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hardwood.operators import desk
from hardwood.streaming import risk

LIMITS = risk.Limits(per_order=50.0, per_market=120.0, cooldown=600.0)
KIND = "market string, order_id long, ts timestamp, stake double"


def test_rule():
    ok, why, exposure, until = risk.decide(30.0, 0.0, 0.0, float("-inf"), LIMITS)
    assert (ok, why, exposure) == (True, "accepted", 30.0)
    assert risk.decide(60.0, 10.0, 30.0, until, LIMITS) == (False, "per order", 30.0, 610.0)
    assert risk.decide(1.0, 609.0, 30.0, 610.0, LIMITS) == (False, "cooldown", 30.0, 610.0)
    assert risk.decide(1.0, 610.0, 30.0, 610.0, LIMITS)[0]
    assert risk.decide(float("nan"), 0.0, 0.0, 0.0, LIMITS)[1] == risk.decide(0.0, 0.0, 0.0, 0.0, LIMITS)[1] == "stake"
    assert risk.decide(50.0, 0.0, 80.0, 0.0, LIMITS)[1] == "per market"


def test_stream_is_batch_and_late_orders_are_left_out(spark, tmp_path):
    rnd = random.Random(1)
    begin = datetime(2024, 1, 1)
    orders = [(rnd.choice("abc"), k, begin + timedelta(seconds=rnd.randrange(20) + 60 * k), float(rnd.choice([0, 10, 25, 40, 70]))) for k in range(200)]
    rnd.shuffle(orders)
    orders.sort(key=lambda o: o[2] + timedelta(seconds=rnd.randrange(1500)))  # arrive up to 25 minutes out of order
    done = [("d", 1000, begin + timedelta(days=1), 1.0)]  # moves the watermark past all others
    late = [("a", 1001, begin + timedelta(hours=2), 5.0)]
    parts = [orders[:80], orders[80:150], orders[150:], done, late, [("d", 1002, begin + timedelta(days=2), 1.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    raw = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = risk.stream_decisions(raw, LIMITS).writeStream.format("memory").queryName("risk").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {r.order_id: (r.market, r.accepted, r.reason, r.exposure) for r in spark.table("risk").collect()}
    want = {r.order_id: (r.market, r.accepted, r.reason, r.exposure) for r in risk.decisions(spark.createDataFrame(orders, KIND), LIMITS).collect()}
    assert {k: v for k, v in got.items() if k < 1000} == want
    assert 1001 not in got and {w[2] for w in want.values()} == {"accepted", "stake", "per order", "per market", "cooldown"}


def test_batch_keeps_markets_apart_and_takes_empty_tables(spark):
    d = spark.createDataFrame([("a", 1, datetime(2024, 1, 1), 90.0), ("b", 2, datetime(2024, 1, 1), 9.0), ("a", 3, datetime(2024, 1, 1, 0, 5), 9.0), ("b", 4, datetime(2024, 1, 1), None)], KIND)
    got = {r.order_id: (r.accepted, r.reason) for r in risk.decisions(d, LIMITS).collect()}
    assert got == {1: (False, "per order"), 2: (True, "accepted"), 3: (False, "cooldown"), 4: (False, "stake")}
    assert risk.decisions(d.where("false"), LIMITS).collect() == []


def test_parlays_of_one_game_pay_less(spark):
    legs = [(1, 1, 7, "points", 150), (1, 1, 7, "points", 200), (2, 1, 7, "points", 150), (2, 2, 8, "assists", 200), (3, 1, 7, "points", -400)]
    d = spark.createDataFrame(legs, "parlay_id long, player_id long, game_id long, market string, odds int")
    got = {r.parlay_id: r for r in desk.parlay_prices(d, F.lit(1.0)).collect()}
    assert got[1].raw_odds == pytest.approx(7.5) == got[2].raw_odds and got[1].priced_odds < 0.4 * got[2].priced_odds and got[2].priced_odds < 7.5
    assert got[3].priced_odds == pytest.approx(1.25)
