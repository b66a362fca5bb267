"""Ledger folds, allocation, branches of availability, redistribution, simulation and parlays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hardwood.functions.rates import near_poisson


def positions(fills: DataFrame) -> DataFrame:
    """Per symbol the stake, average price and realized profit after its fills in order.

    The fold depends on order, so a symbol's fills are one sorted list; sales beyond the stake are cut to it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ts", "fill_id", "side", "stake", "price")))
    zero = F.struct(F.lit(0.0).alias("stake"), F.lit(0.0).alias("avg"), F.lit(0.0).alias("pnl"))

    def step(s, f):
        bought = s["stake"] + f["stake"]
        sold = F.least(s["stake"], f["stake"])
        left = s["stake"] - sold
        buy = F.struct(bought.alias("stake"), F.when(bought > 0, (s["stake"] * s["avg"] + f["stake"] * f["price"]) / bought).otherwise(0.0).alias("avg"), s["pnl"].alias("pnl"))
        sell = F.struct(left.alias("stake"), F.when(left > 0, s["avg"]).otherwise(0.0).alias("avg"), (s["pnl"] + sold * (f["price"] - s["avg"])).alias("pnl"))
        return F.when(f["side"] == "buy", buy).otherwise(sell)

    p = fills.groupBy("symbol").agg(F.aggregate(ordered, zero, step).alias("p"), F.count(F.lit(1)).alias("fills"))
    return p.select("symbol", F.col("p.stake").alias("open_stake"), F.col("p.avg").alias("avg_price"), F.col("p.pnl").alias("realized_pnl"), "fills")


def allocate(rows: DataFrame, group: str, weight: str, budget: float, cap: float = 0.35, rounds: int = 3) -> DataFrame:
    """Shares of a budget in proportion to weight, none over ``cap`` of it; what is cut goes to the rest, ``rounds`` times."""
    w = Window.partitionBy(group)
    top = budget * cap
    d = rows.withColumn("stake", F.lit(0.0)).withColumn("open", F.col(weight) > 0)
    for _ in range(rounds):
        left = F.lit(budget) - F.sum("stake").over(w)
        total = F.sum(F.when(F.col("open"), F.col(weight)).otherwise(0.0)).over(w)
        d = d.withColumn("stake", F.when(F.col("open") & (total > 0), F.least(F.lit(top), F.col("stake") + left * F.col(weight) / total)).otherwise(F.col("stake")))
        d = d.withColumn("open", F.col("open") & (F.col("stake") < top - 1e-9))
    return d.drop("open")


def branches(players: DataFrame, group: str, exact: int = 8, draws: int = 2048, seed: str = "branch") -> DataFrame:
    """Who plays: all 2^n combinations with their probabilities for groups of up to ``exact`` players, else ``draws`` sampled ones over all players.

    A sampled branch's draws follow a hash of group, branch and player, so they depend on neither partitions nor
    re-runs; (branch, player) rows are aggregated per branch, so a large group spreads over all tasks.
    """
    sized = players.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    small = sized.where(F.col("_n") <= exact)
    g = small.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("player_id", "p_play"))).alias("who"))
    b = g.select(group, "who", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("who")) - 1)).alias("branch"))
    bit = lambda i: F.call_function("shiftright", F.col("branch"), i).bitwiseAND(1)
    who = F.zip_with("who", F.sequence(F.lit(0), F.size("who") - 1), lambda x, i: F.struct(x["p_play"].alias("p"), bit(i).alias("in")))
    p = F.aggregate(who, F.lit(1.0), lambda s, x: s * F.when(x["in"] == 1, x["p"]).otherwise(1 - x["p"]))
    n = F.aggregate(who, F.lit(0).cast("long"), lambda s, x: s + x["in"].cast("long"))
    full = b.select(group, F.col("branch").cast("long").alias("branch"), p.alias("probability"), n.alias("n_playing"))
    drawn = sized.where(F.col("_n") > exact).withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string"), F.col("branch").cast("string"), F.col("player_id").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    drawn = drawn.groupBy(group, F.col("branch").cast("long").alias("branch")).agg(F.count(F.when(u < F.col("p_play"), 1)).alias("n_playing"))
    return full.unionByName(drawn.select(group, "branch", F.lit(1.0 / draws).alias("probability"), "n_playing"))


def redistribute(roster: DataFrame, cap: float = 48.0) -> DataFrame:
    """Minutes of the absent go to the others of a team in proportion to their weight, none over the cap, until none is left or all are full.

    Rows: ``game_id, team_id, player_id, minutes, weight, absent`` and, if there, ``cap`` per player. Sharing out
    what is left again and again ends at one level: everyone has weight times level or is full. Ordered by room over
    weight, a player is full if all are served up to that player's own level; two running sums tell.
    """
    top = F.coalesce(F.col("cap"), F.lit(cap)) if "cap" in roster.columns else F.lit(cap)
    w = Window.partitionBy("game_id", "team_id")
    away = F.col("absent")
    d = roster.select("game_id", "team_id", "player_id", "absent", F.col("minutes").cast("double").alias("minutes"), F.when(~away, F.greatest(top - F.col("minutes"), F.lit(0.0))).otherwise(0.0).alias("room"), F.col("weight").cast("double").alias("weight"))
    d = d.withColumn("open", ~away & (F.col("weight") > 0) & (F.col("room") > 1e-9)).withColumn("pool", F.sum(F.when(away, F.col("minutes")).otherwise(0.0)).over(w))
    room, weight = F.when(F.col("open"), F.col("room")).otherwise(0.0), F.when(F.col("open"), F.col("weight")).otherwise(0.0)
    before = w.orderBy(F.when(F.col("open"), F.col("room") / F.col("weight")).otherwise(-1.0), "player_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"r0": F.coalesce(F.sum(room).over(before), F.lit(0.0)), "w0": F.sum(weight).over(w) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))})
    d = d.withColumn("full", F.col("open") & (F.col("r0") + F.col("room") / F.col("weight") * F.col("w0") <= F.col("pool")))
    used = F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(w)
    free = F.sum(F.when(F.col("open") & ~F.col("full"), F.col("weight")).otherwise(0.0)).over(w)
    gain = F.when(F.col("full"), F.col("room")).when(F.col("open"), F.col("weight") * F.try_divide(F.col("pool") - used, free)).otherwise(0.0)
    return d.select("game_id", "team_id", "player_id", F.when(away, 0.0).otherwise(F.col("minutes") + gain).alias("new_minutes"), F.when(free > 0, 0.0).otherwise(F.greatest(F.col("pool") - used, F.lit(0.0))).alias("unplaced"))


def count_distribution() -> tuple:
    """Columns of the fitted count distribution of ``mean`` and ``variance``: Poisson up to 1.05 times the mean, else negative binomial."""
    poisson = near_poisson(F.col("mean"), F.col("variance"))
    n = F.when(~poisson, F.col("mean") * F.col("mean") / (F.col("variance") - F.col("mean")))
    return F.when(poisson, "poisson").otherwise("negative_binomial").alias("family"), n.alias("size"), F.when(~poisson, F.col("mean") / F.col("variance")).alias("prob")


def simulate(rows: DataFrame, least: int = 10_000, most: int = 100_000, margin: float = 0.01) -> DataFrame:
    """Over probability of ``(quote_id, mean, variance, line)`` by drawing in batches until the 95 % margin is met.

    Seeds follow quote_id, so results do not depend on partitions. Jeffreys' estimate (k + 1/2) / (n + 1).
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, mean, var, line in zip(b.quote_id, b["mean"], b["variance"], b["line"], strict=True):
                rnd = np.random.default_rng(int(q) & 0xFFFFFFFF)
                n = k = boom = 0
                total = 0.0
                while n < most:
                    x = rnd.poisson(mean, least) if near_poisson(mean, var) else rnd.negative_binomial(mean * mean / (var - mean), mean / var, least)
                    n, k, boom, total = n + least, k + int((x > line).sum()), boom + int((x >= 1.1 * line).sum()), total + float(x.sum())
                    p = k / n
                    if 1.96 * (p * (1 - p) / n) ** 0.5 <= margin:
                        break
                out.append((q, (k + 0.5) / (n + 1), total / n, boom / n, n))
            yield pd.DataFrame(out, columns=["quote_id", "over_probability", "sample_mean", "boom", "draws"])

    return rows.select("quote_id", "mean", "variance", "line").mapInPandas(go, "quote_id long, over_probability double, sample_mean double, boom double, draws long")


def compose(player: list, game: list, market: list, size: int) -> list[int]:
    """Places of the first legs that make a parlay of ``size``: new markets and games first, repeats only as they are needed, no player twice; empty unless two games or more take part."""
    chosen, players, games, markets = [], set(), Counter(), Counter()
    repeats = max(2, -(-size // len(set(market))))
    fresh = lambda i: games[game[i]] == 0
    phases = (lambda i: markets[market[i]] == 0 and fresh(i), fresh, lambda i: markets[market[i]] == 0, lambda i: markets[market[i]] < repeats, lambda i: True)
    for fits in phases:
        for i in range(len(player)):
            if len(chosen) < size and player[i] not in players and fits(i):
                chosen.append(i)
                players.add(player[i])
                games[game[i]] += 1
                markets[market[i]] += 1
    return chosen if len(chosen) == size and len(games) > 1 else []


def parlays(legs: DataFrame, group: str, least: int = 3, most: int = 20, draws: int = 12_000, top: int = 20) -> DataFrame:
    """Greedy parlays of ``least`` to ``most`` legs per book, the ``top`` of each leg count, with a joint probability by Gaussian copula.

    Legs: ``leg_id, player_id, game_id, market_key, line_value, p, price``. Of equal legs the one of most profit counts.
    A book's board is cut to its best legs, once by probability, by profit and by edge, before it is grouped; :func:`compose` chooses from each place of each order.
    """
    p, profit, edge = F.col("p"), F.col("p") * F.col("price") - 1, F.col("p") - 1 / F.col("price")
    one = legs.groupBy(group, "game_id", "player_id", "market_key", "line_value").agg(F.max_by(F.struct("leg_id", "p", "price"), F.struct(profit, -F.col("leg_id"))).alias("leg"))
    one = one.select(group, "game_id", "player_id", "market_key", "leg.*")
    orders = F.array(*[F.struct(F.lit(k).alias("order"), F.array(*by).alias("by")) for k, by in enumerate(((p, profit, edge), (profit, edge, p), (edge, profit, p)))])
    ordered = one.withColumn("_o", F.explode(orders)).select("*", "_o.order", "_o.by").drop("_o")
    w = Window.partitionBy(group, "order").orderBy(F.desc("by"), "leg_id")
    board = ordered.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 60).drop("by")
    board = board.withColumn("leg_count", F.explode(F.sequence(F.lit(least), F.lit(most))))

    def build(b: pd.DataFrame) -> pd.DataFrame:
        from statistics import NormalDist

        size, seen, out = int(b.leg_count.iat[0]), set(), []
        for _, o in b.sort_values("_k").groupby("order"):
            player, game, market = (o[c].tolist() for c in ("player_id", "game_id", "market_key"))
            for start in range(len(o) - size + 1):
                c = o.iloc[[start + i for i in compose(player[start:], game[start:], market[start:], size)]]
                ids = tuple(sorted(c.leg_id.tolist()))
                if not ids or ids in seen:
                    continue
                seen.add(ids)
                c = c.sort_values("leg_id")
                same = c.game_id.to_numpy()[:, None] == c.game_id.to_numpy()[None, :]
                corr = np.where(same, 0.15, 0.0)
                np.fill_diagonal(corr, 1.0)
                z = np.random.default_rng(int(sum(ids)) & 0xFFFFFFFF).standard_normal((draws, size)) @ np.linalg.cholesky(corr).T
                cut = np.array([NormalDist().inv_cdf(min(max(x, 1e-6), 1 - 1e-6)) for x in c.p])
                joint = float((z <= cut).all(1).mean())
                price = float(np.prod(c.price))
                out.append((b[group].iat[0], size, ",".join(map(str, ids)), joint, price, joint * price - 1))
        return pd.DataFrame(sorted(out, key=lambda r: (-r[5], r[2]))[:top], columns=[group, "leg_count", "legs", "joint_probability", "price", "expected_value"])

    kind = board.schema[group].dataType.simpleString()
    return board.groupBy(group, "leg_count").applyInPandas(build, f"{group} {kind}, leg_count int, legs string, joint_probability double, price double, expected_value double")
