"""Live state with Structured Streaming: ticker frames, the latest book, fills once, positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME = "type string, msg struct<market_ticker:string, yes_bid_dollars:string, yes_ask_dollars:string, last_dollars:string, status:string>, seq long"


def frames(raw: DataFrame) -> DataFrame:
    """Ticker frames of a ``value`` column of JSON: numbers or null, spread to four places; other frames go."""
    f = raw.select(F.from_json("value", FRAME).alias("f")).select("f.*").where("type = 'ticker' and msg.market_ticker <> ''")
    f = f.select("seq", F.col("msg.market_ticker").alias("ticker"), *[F.col(f"msg.{c}_dollars").try_cast("double").alias(c) for c in ("yes_bid", "yes_ask", "last")], F.col("msg.status").alias("status"))
    return f.withColumn("spread", F.round(F.col("yes_ask") - F.col("yes_bid"), 4))


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, ask in zip(rows["seq"], rows["yes_ask"], strict=True):
        now = None if pd.isna(ask) else float(ask)
        out.append((key[0], int(seq), before, now))
        before = now
    state.update((before,))
    yield pd.DataFrame(out, columns=["ticker", "seq", "before", "after"])


def book_changes(ticks: DataFrame) -> DataFrame:
    """Each arrival with the price before it; the last arrival of a ticker is its state."""
    return ticks.groupBy("ticker").applyInPandasWithState(_changes, "ticker string, seq long, before double, after double", "price double", "append", GroupStateTimeout.NoTimeout)


def fills_once(fills: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each fill_id once within the watermark."""
    return fills.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fill_id"])


def windowed_health(events: DataFrame, delay: str = "10 minutes", size: str = "6 hours") -> DataFrame:
    """Events, errors and mean value per window of event time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value"))
