"""Count distributions, their mixtures over branches and absence, pooled means, and ranked fall-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hardwood.functions.odds import clip
from hardwood.functions.rates import near_poisson
from hardwood.sources.tables import stored

# How strongly a prior counts, and how much wider a variance is, by tier of data.
STRENGTH = {"A": 10.0, "B": 15.0, "C": 25.0, "D": 50.0}
WIDER = {"A": 1.0, "B": 1.3, "C": 2.0, "D": 3.0}


def _recursion(mean: Column, variance: Column) -> tuple[Column, Column, Column]:
    """``p0, a, b`` of the recursion ``p(k) = p(k - 1) (a + b / k)``: Poisson up to 1.05 times the mean, else negative binomial."""
    poisson = near_poisson(mean, variance)
    q, r = mean / variance, mean * mean / (variance - mean)
    p0 = F.when(poisson, F.exp(-mean)).otherwise(F.pow(q, r))
    return p0, F.when(poisson, 0.0).otherwise(1 - q), F.when(poisson, mean).otherwise((r - 1) * (1 - q))


def reach(mean: Column, variance: Column, q: float) -> Column:
    """A count that is at least the quantile q: no more than 1 - q lies ``sqrt(q / (1 - q))`` deviations above a mean (Cantelli)."""
    return F.ceil(mean + (q / (1 - q)) ** 0.5 * F.sqrt(variance) + 2).cast("int")


def count_cdf(mean: Column, variance: Column, most: Column) -> Column:
    """``array<double>``: P(X <= k) for k from 0 to ``most``."""
    p0, a, b = _recursion(mean, variance)
    start = F.struct(p0.alias("p"), F.array(p0).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * (a + b / k)).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * (a + b / k))).alias("cdf"))
    return F.when(most < 1, F.array(p0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), start, step, lambda s: s["cdf"]))


def at_most(mean: Column, variance: Column, k: Column) -> Column:
    """P(X <= k), a finite sum; 0 below 0, 1 for a mean of 0."""
    p0, a, b = _recursion(mean, variance)
    start = F.struct(p0.alias("p"), p0.alias("s"))
    step = lambda s, i: F.struct((s["p"] * (a + b / i)).alias("p"), (s["s"] + s["p"] * (a + b / i)).alias("s"))
    more = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), start, step, lambda s: s["s"])
    return F.when(k < 0, 0.0).when(mean <= 0, 1.0).when(k < 1, p0).otherwise(F.least(more, F.lit(1.0)))


def prop_tails(rows: DataFrame) -> DataFrame:
    """``(quote_id, mean, variance, line)`` with over, push, under, boom (110 % of the line) and bust (70 %) probabilities, exact."""
    m, v, line = F.col("mean"), F.col("variance"), F.col("line")
    under = at_most(m, v, F.ceil(line) - 1)
    upto = at_most(m, v, F.floor(line))
    return rows.select("quote_id", "mean", "variance", "line", (1 - upto).alias("over_probability"), (upto - under).alias("push_probability"), under.alias("under_probability"),
                       (1 - at_most(m, v, F.ceil(1.1 * line) - 1)).alias("boom_probability"), at_most(m, v, F.floor(0.7 * line)).alias("bust_probability"))


def dnp_mixture(rows: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``(quote_id, mean, variance, line, dnp)``: a player who does not play with probability ``dnp`` counts 0.

    ``mean`` and ``variance`` are those of a game played. Gives the mixture's mean, variance, tails and quantiles: with d
    the risk, ``F = d + (1 - d) F_play``, so a quantile q is 0 up to d and else F_play's at ``(q - d) / (1 - d)``.
    """
    # other names than the result's: inside a lambda a column may be taken for an alias of the same select
    d, m, v, line = (F.col(c) for c in ("_d", "_m", "_v", "line"))
    most = reach(m, v, max(quantiles))
    r = rows.select("quote_id", "line", F.col("mean").alias("_m"), F.col("variance").alias("_v"), clip(F.coalesce("dnp", F.lit(0.0)), 0.0, 1.0).alias("_d"))
    r = r.withColumn("_cdf", count_cdf(m, v, most))
    at = lambda q: F.size(F.filter("_cdf", lambda c: d + (1 - d) * c < q - 1e-12))
    mixed = (1 - d) * m
    return r.select("quote_id", mixed.alias("mean"), ((1 - d) * (v + m * m) - mixed * mixed).alias("variance"), ((1 - d) * (1 - at_most(m, v, F.floor(line)))).alias("over_probability"),
                    ((1 - d) * (1 - at_most(m, v, F.ceil(1.1 * line) - 1))).alias("boom_probability"), (d + (1 - d) * at_most(m, v, F.floor(0.7 * line))).alias("bust_probability"),
                    *[F.when(F.lit(q) <= d, 0).otherwise(at(q)).cast("int").alias(f"p{round(100 * q)}") for q in quantiles])


def branch_frames(players: DataFrame, doubts: DataFrame, most: int = 8, sampled: int = 2048) -> DataFrame:
    """``(game_id, team_id, branch, probability, absent, lost)``: the ways in which a game's doubtful players of a team can turn out.

    ``doubts`` is ``(game_id, team_id, player_id, p_play, usage)``. Up to ``most`` doubtful players give every combination with its
    probability; more give ``sampled`` branches of equal weight, in each of which every player's own hash says whether
    they play. Teams without doubts have one branch. A branch is one row; players are an array of the team's doubts.
    """
    d = doubts.groupBy("game_id", "team_id").agg(F.sort_array(F.collect_list(F.struct("player_id", "p_play", "usage"))).alias("all"))
    exact = F.size("all") <= most
    d = d.withColumn("exact", exact).withColumn("branch", F.explode(F.sequence(F.lit(0), F.when(exact, F.call_function("shiftleft", F.lit(1), F.size("all"))).otherwise(sampled) - 1)))
    drawn = lambda x: F.pmod(F.xxhash64("game_id", "team_id", "branch", x["player_id"]), F.lit(1 << 20)) / float(1 << 20) >= x["p_play"]
    out = lambda x, i: F.when(F.col("exact"), F.call_function("shiftright", F.col("branch"), i).bitwiseAND(1) == 0).otherwise(drawn(x))  # noqa: E731  a set bit plays
    ways = F.aggregate(F.transform("all", lambda x, i: F.when(out(x, i), 1 - x["p_play"]).otherwise(x["p_play"])), F.lit(1.0), lambda s, p: s * p)
    gone = F.filter("all", out)
    d = d.select("game_id", "team_id", "branch", F.when(F.col("exact"), ways).otherwise(1.0 / sampled).alias("probability"), F.size(gone).alias("absent"), F.aggregate(gone, F.lit(0.0), lambda s, x: s + x["usage"]).alias("lost"))
    none = players.select("game_id", "team_id").distinct().join(doubts.select("game_id", "team_id").distinct(), ["game_id", "team_id"], "left_anti")
    return d.unionByName(none.select("game_id", "team_id", F.lit(0).alias("branch"), F.lit(1.0).alias("probability"), F.lit(0).alias("absent"), F.lit(0.0).alias("lost")))


def branch_mixture(rows: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """``(keys, weight, mean, variance, line)`` rows, one a branch: the mixture's mean, variance, over probability and quantiles.

    Moments and tails are weighted sums. A quantile inverts the weighted sum of the branches' distribution functions,
    which Spark adds up value by value; nothing is drawn. Weights that sum to nothing count alike.
    """
    w = F.greatest("weight", F.lit(0.0))
    top = reach(F.col("mean"), F.col("variance"), max(quantiles))
    per = stored(rows.select(*keys, w.alias("w"), "mean", "variance", "line", (1 - at_most(F.col("mean"), F.col("variance"), F.floor("line"))).alias("over"), top.alias("top")))  # read four times below
    total = per.groupBy(*keys).agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("branches"), F.max("top").alias("most"))
    per = per.join(total, keys).withColumn("w", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(1 / F.col("branches")))
    moments = per.groupBy(*keys).agg(F.max("branches").alias("branches"), F.sum(F.col("w") * F.col("mean")).alias("mean"), F.sum(F.col("w") * (F.col("variance") + F.col("mean") * F.col("mean"))).alias("second"),
                                     F.sum(F.col("w") * F.col("over")).alias("over_probability"))
    # branches of equal moments have one distribution function; a branch alone is its own mixture
    alike = per.where("branches > 1").groupBy(*keys, "mean", "variance", "most").agg(F.sum("w").alias("w"))
    cdf = count_cdf(F.col("mean"), F.col("variance"), F.col("most"))
    steps = alike.select(*keys, "w", F.posexplode(cdf).alias("_count", "_c")).groupBy(*keys, "_count").agg(F.sum(F.col("w") * F.col("_c")).alias("f"))
    at = steps.groupBy(*keys).agg(*[F.min(F.when(F.col("f") >= q - 1e-12, F.col("_count"))).alias(f"p{round(100 * q)}") for q in quantiles])
    below = lambda q: F.size(F.filter("_cdf", lambda c: c < q - 1e-12))
    alone = per.where("branches = 1").select(*keys, cdf.alias("_cdf"))
    at = at.unionByName(alone.select(*keys, *[F.when(below(q) < F.size("_cdf"), below(q)).alias(f"p{round(100 * q)}") for q in quantiles]))
    out = moments.join(at, keys)
    return out.select(*keys, "branches", "mean", (F.col("second") - F.col("mean") * F.col("mean")).alias("variance"), "over_probability", *[f"p{round(100 * q)}" for q in quantiles])


def role_priors(rows: DataFrame) -> DataFrame:
    """``(position, role, total, rate, spread)``: priors of all rows, of a position, and of a position's starters or others, by one grouping.

    ``rows`` is ``(position, role, value, minutes)``; levels that are summed over are null.
    """
    c = rows.cube("position", "role").agg(F.avg("value").alias("total"), F.try_divide(F.sum("value"), F.sum("minutes")).alias("rate"), F.var_samp("value").alias("spread"), F.grouping_id().alias("level"))
    return c.where("level in (0, 1, 3)")  # (position, role), (position), ()


def pooled_means(rows: DataFrame, priors: DataFrame, strength: float = 20.0) -> DataFrame:
    """``rows`` with ``pooled_mean`` and ``pooled_variance``: means drawn to priors the less is known of a player.

    Rows hold ``mean, variance, baseline, avg_10, season, games, minutes_played, exposure, role_stability, lineup_instability,
    minutes_uncertainty, role_delta, same_position_out, position, role, tier``. Reliability is from games and minutes, the role and the
    line-up; the prior mixes the baseline, recent and season means with position and role priors, by total or by rate.
    """
    level = lambda n, p, *keys: priors.where(f"level = {n}").select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("total", "rate", "spread")])
    d = rows.join(level(0, "role", "position", "role"), ["position", "role"], "left").join(level(1, "pos", "position"), "position", "left").crossJoin(F.broadcast(level(3, "all")))
    total, pos_rate = F.coalesce("pos_total", "all_total"), F.coalesce("pos_rate", "all_rate")
    role_total, role_rate = F.coalesce(F.col("role_total"), total), F.coalesce(F.col("role_rate"), pos_rate)
    zero = lambda x: F.greatest(x, F.lit(0.0))
    exposure = zero(F.col("exposure"))
    prior = zero(0.30 * F.col("baseline") + 0.25 * F.col("avg_10") + 0.20 * F.col("season") + 0.15 * F.greatest(total, zero(pos_rate * exposure)) + 0.10 * F.greatest(role_total, zero(role_rate * exposure)))
    by_tier = lambda table, other: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("tier")], F.lit(other))
    sample = F.col("games") / (F.col("games") + by_tier(STRENGTH, strength))
    stable = clip(0.55 + 0.45 * F.col("role_stability"), 0.35, 1.0)
    calm = clip(1 - 0.35 * F.col("lineup_instability") - 0.25 * F.col("minutes_uncertainty"), 0.25, 1.0)
    reliable = clip(0.5 * sample + 0.5 * F.least(F.col("minutes_played") / 320, F.lit(1.0)), 0.05, 0.98) * stable * calm
    wider = 1 + 0.35 * clip(F.col("lineup_instability"), 0.0, 1.0) + 0.28 * clip(F.col("minutes_uncertainty"), 0.0, 1.5) + 0.20 * clip(F.col("role_delta"), 0.0, 1.5) + 0.06 * clip(F.col("same_position_out"), 0.0, 4.0)
    variance = F.greatest("variance", F.coalesce("role_spread", F.lit(0.0))) * wider * by_tier(WIDER, 1.0)
    return d.select(*rows.columns, reliable.alias("reliability"), zero(reliable * F.col("mean") + (1 - reliable) * prior).alias("pooled_mean"), variance.alias("pooled_variance"))


def lookup_weights(asked: DataFrame, weights: DataFrame) -> DataFrame:
    """``asked`` ``(team_id, season, absent, candidate)`` with the weights of the best row that fits: team and season, team, league and season, league, then 1.

    ``weights`` has ``(team_id, season, absent, candidate, minute_weight, usage_weight)``, null season for all seasons and
    team ``LEAGUE`` for all teams. Rows are spread over the keys that can ask for them and met by one join on
    (absent, candidate, team); the least rank wins, so there is no chain of joins.
    """
    rank = F.when(F.col("w.team_id") == "LEAGUE", 3).otherwise(0) + F.when(F.col("w.season").isNull(), 1).otherwise(0)
    a = asked.withColumn("of", F.explode(F.array(F.col("team_id").cast("string"), F.lit("LEAGUE"))))
    fits = (F.col("a.absent") == F.col("w.absent")) & (F.col("a.candidate") == F.col("w.candidate")) & (F.col("a.of") == F.col("w.team_id").cast("string")) & (F.col("w.season").isNull() | (F.col("w.season") == F.col("a.season")))
    j = a.alias("a").join(weights.alias("w"), fits, "left")
    held = F.struct(F.coalesce("w.minute_weight", F.lit(1.0)).alias("minute_weight"), F.coalesce("w.usage_weight", F.lit(1.0)).alias("usage_weight"), F.when(F.col("w.team_id").isNull(), "fallback").when(F.col("w.team_id") == "LEAGUE", "league").otherwise("team").alias("source"))
    best = j.groupBy(*[F.col(f"a.{c}").alias(c) for c in asked.columns]).agg(F.min_by(held, F.when(F.col("w.team_id").isNull(), 9).otherwise(rank)).alias("b"))
    return best.select(*asked.columns, F.greatest("b.minute_weight", F.lit(0.0)).alias("minute_weight"), F.greatest("b.usage_weight", F.lit(0.0)).alias("usage_weight"), F.col("b.source").alias("source"))
