"""Orders against limits, with a cooldown after a refusal: one rule for batch and for streams.

``decide`` is the rule for one order and the state of its market. In batch, partitions sorted by market and time pass
through it with one market's state at a time, so a market's history may be of any length. In a stream the orders of
a market wait in its state until the watermark has passed them and then pass in order of time, so both give the
same decisions on the same orders; orders later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "market string, order_id long, ts timestamp, stake double, accepted boolean, reason string, exposure double"


@dataclass(frozen=True)
class Limits:
    """Most of an order, most in a market, and seconds in which a market takes no order after one was refused."""

    per_order: float
    per_market: float
    cooldown: float


def decide(stake: float, at: float, exposure: float, until: float, limits: Limits) -> tuple[bool, str, float, float]:
    """Accepted, reason, the market's exposure, and the end of its cooldown. An order in the cooldown does not extend it."""
    if at < until:
        return False, "cooldown", exposure, until
    if not stake > 0:
        reason = "stake"
    elif stake > limits.per_order:
        reason = "per order"
    elif exposure + stake > limits.per_market:
        reason = "per market"
    else:
        return True, "accepted", exposure + stake, until
    return False, reason, exposure, at + limits.cooldown


def decisions(orders: DataFrame, limits: Limits) -> DataFrame:
    """Every order of ``(market, order_id, ts, stake)`` with its decision, by time and order_id within a market."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        market, exposure, until = None, 0.0, float("-inf")
        for b in batches:
            out = []
            for m, t, stake in zip(b.market, b.ts, b.stake, strict=True):
                if m != market:
                    market, exposure, until = m, 0.0, float("-inf")
                ok, reason, exposure, until = decide(stake, t.value // 1000 / 1e6, exposure, until, limits)
                out.append((ok, reason, exposure))
            yield b.assign(**dict(zip(("accepted", "reason", "exposure"), zip(*out, strict=True), strict=True))) if out else b.assign(accepted=[], reason=[], exposure=[])

    d = orders.select("market", "order_id", orders.ts.cast("timestamp").alias("ts"), "stake")
    return d.repartition("market").sortWithinPartitions("market", "ts", "order_id").mapInPandas(go, DECISION)


def stream_decisions(orders: DataFrame, limits: Limits, delay: str = "1 hour") -> DataFrame:
    """The same for a stream; an order is decided once the watermark (``delay`` behind the newest order) has passed it."""

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        exposure, until, held = (state.get[0], state.get[1], json.loads(state.get[2])) if state.exists else (0.0, float("-inf"), [])
        for b in batches:
            held += [[t.value // 1000, int(i), float(s)] for t, i, s in zip(b.ts, b.order_id, b.stake, strict=True)]
        mark = state.getCurrentWatermarkMs() * 1000  # microseconds, as the orders' times
        held.sort()
        out = []
        while held and held[0][0] <= mark:
            at, order, stake = held.pop(0)
            ok, reason, exposure, until = decide(stake, at / 1e6, exposure, until, limits)
            out.append((key[0], order, pd.Timestamp(at, unit="us"), stake, ok, reason, exposure))
        state.update((exposure, until, json.dumps(held)))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["market", "order_id", "ts", "stake", "accepted", "reason", "exposure"])

    d = orders.withWatermark("ts", delay).select("market", "order_id", "ts", "stake")
    return d.groupBy("market").applyInPandasWithState(go, DECISION, "exposure double, until double, held string", "append", GroupStateTimeout.EventTimeTimeout)
