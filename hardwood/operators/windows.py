"""Point-in-time features over a player's earlier games. Every frame ends before the current row.

Order is ``game_date, start_time, game_id`` within a player, which is total. Features over one window
specification are built in one select, so Catalyst sorts once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import places
from .slices import ORDER, sliced_means

WINDOWS = (3, 5, 10, 20)


def by(*keys: str):
    return Window.partitionBy(*keys).orderBy(*ORDER)


def before(w, n: int | None = None):
    """The n rows before the current one, or all of them."""
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def at_least(x: Column, value: Column, frame, least: int) -> Column:
    """A window value only where the frame has ``least`` values that are not null."""
    return F.when(F.count(x).over(frame) >= least, value)


def rolling_mean(x: Column, w, n: int) -> Column:
    f = before(w, n)
    return at_least(x, F.avg(x).over(f), f, min(max(3, n // 2), n))


def rolling_std(x: Column, w, n: int) -> Column:
    f = before(w, n)
    return at_least(x, F.stddev_samp(x).over(f), f, 3)


def ewm(rows: DataFrame, x: Column, name: str, key: str = "player_id", span: int = 10, reach: int = 200) -> DataFrame:
    """``rows`` with the exponentially weighted mean of the earlier rows' ``x``; a null only lets the old weight decay.

    Between known values the mean is ``y + c (x - y)`` with c from the steps passed, so each takes at least
    ``a = 2 / (span + 1)`` off what was before: the last ``reach`` of them leave (1 - a)^reach of the rest, below a
    double's precision, and a row folds no more, however long the history.
    """
    a = 2.0 / (span + 1)
    w = Window.partitionBy(key)
    d = rows.withColumns({"_x": x.cast("double"), "_n": F.row_number().over(by(key))})
    d = d.withColumn("_last", F.max(F.when(F.col("_x").isNotNull(), F.col("_n"))).over(w.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)))
    known = d.where("_x is not null").select(key, "_n", "_x", F.pow(F.lit(1 - a), F.col("_n") - F.lag("_n").over(w.orderBy("_n"))).alias("_old"))
    steps = F.collect_list(F.struct(F.coalesce(a / (F.col("_old") + a), F.lit(1.0)).alias("c"), "_x")).over(w.orderBy("_n").rowsBetween(1 - reach, 0))
    y = F.aggregate(steps, F.lit(None).cast("double"), lambda s, e: F.when(s.isNull(), e["_x"]).otherwise(s + e["c"] * (e["_x"] - s)))
    known = known.select(F.col(key), F.col("_n").alias("_last"), y.alias(name))
    return d.join(known, [key, "_last"], "left").select(*rows.columns, name)


def recent_features(games: DataFrame, metrics: tuple[str, ...] = ("minutes", "points")) -> DataFrame:
    """Lag, means over 3/5/10/20 games, standard deviation, all-history mean; nulls filled from the next longer window."""
    w = by("player_id")
    cols = []
    for m in metrics:
        x = F.col(m).cast("double")
        means = [rolling_mean(x, w, n) for n in WINDOWS]
        season = F.avg(x).over(before(w))
        cols.append(F.coalesce(F.lag(x).over(w), F.lit(0.0)).alias(f"{m}_prev"))
        cols += [F.coalesce(*means[i:], season, F.lit(0.0)).alias(f"{m}_avg_{n}") for i, n in enumerate(WINDOWS)]
        cols += [F.coalesce(rolling_std(x, w, 10), rolling_std(x, w, 20), F.lit(0.0)).alias(f"{m}_std_10"), F.coalesce(season, F.lit(0.0)).alias(f"{m}_season_avg")]
    return games.select("player_id", "game_id", *cols)


def dnp_anomalies(games: DataFrame) -> DataFrame:
    """Games cut short: minutes under 40 % of the median of three or more earlier games, which is 12 or more."""
    f = before(by("player_id"))
    m = F.col("minutes")
    median = at_least(m, F.percentile(m, F.lit(0.5)).over(f), f, 3)
    g = games.select("player_id", "game_id", "minutes", median.alias("prior_median"))
    return g.withColumn("anomaly", F.coalesce((F.col("minutes") < 0.4 * F.col("prior_median")) & (F.col("prior_median") >= 12) & ~(F.col("minutes") < 5), F.lit(False)))


def home_away_split(games: DataFrame, metric: str = "points") -> DataFrame:
    """Mean of the last ten games at home and away, by earlier rows; the plain mean of ten where there is none."""
    w = by("player_id")
    x, home = F.lag(F.col(metric).cast("double")).over(w), F.lag(F.col("is_home").cast("int")).over(w)
    g = games.select("player_id", "game_id", *ORDER[:2], x.alias("x"), home.alias("h"))
    f = w.rowsBetween(-9, 0)
    avg = F.avg("x").over(f)
    enough = F.count("x").over(f) >= 3
    part = lambda h: F.when(enough, F.try_divide(F.sum(F.when(F.col("h") == h, F.col("x"))).over(f), F.sum(F.when(F.col("h") == h, 1.0)).over(f)))
    return g.select("player_id", "game_id", F.coalesce(part(1), avg, F.lit(0.0)).alias("home_avg_10"), F.coalesce(part(0), avg, F.lit(0.0)).alias("away_avg_10"))


def rest_and_counters(games: DataFrame) -> DataFrame:
    """Days of rest (4 at first, 0 to 14), back-to-back, games and minutes so far."""
    w = by("player_id")
    days = F.coalesce(F.datediff("game_date", F.lag("game_date").over(w)), F.lit(4))
    rest = F.least(F.greatest(days, F.lit(0)), F.lit(14))
    return games.select("player_id", "game_id", rest.cast("long").alias("days_rest"), (rest <= 1).alias("back_to_back"), (F.row_number().over(w) - 1).cast("long").alias("games_played"),
                        F.coalesce(F.sum("minutes").over(before(w)), F.lit(0.0)).alias("minutes_so_far"))


def role_features(games: DataFrame) -> DataFrame:
    """Starter share of ten games and the 20 % quantile of their minutes."""
    w = by("player_id")
    f = before(w, 10)
    return games.select("player_id", "game_id", F.coalesce(F.avg(F.col("starter").cast("double")).over(f), F.lit(0.0)).alias("starter_share"),
                        F.coalesce(at_least(F.col("minutes"), F.percentile("minutes", F.lit(0.2)).over(f), f, 3), F.lit(0.0)).alias("minutes_floor"))


def opponent_allowed(games: DataFrame, metric: str = "points") -> DataFrame:
    """What an opponent allowed in earlier games: to this player (3), to the position (10), to anyone (10); the first known.

    Opponents and positions are few, so their windows run over monthly slices.
    """
    ids = ["player_id", "game_id"]
    mine = games.select(*ids, F.avg(F.col(metric).cast("double")).over(before(by("player_id", "opponent_team_id"), 3)).alias("mine"))
    pos = sliced_means(games, ["opponent_team_id", "position"], {"pos": (metric, 10)}, ids)
    any_ = sliced_means(games, ["opponent_team_id"], {"allowed_any_10": (metric, 10)}, ids)
    d = mine.join(pos, ids).join(any_, ids)
    return d.select(*ids, F.coalesce("mine", "pos", "allowed_any_10", F.lit(0.0)).alias("allowed"), "allowed_any_10")


def hit_rate(games: DataFrame) -> DataFrame:
    """Share of the ten earlier games above a line of their own (null lines leave a gap); one half if unknown."""
    line = F.col("minutes") / 4
    hit = F.when(line > 0, F.when(F.col("points") > line, 1.0).otherwise(0.0))
    return games.select("player_id", "game_id", F.coalesce(F.avg(hit).over(before(by("player_id"), 10)), F.lit(0.5)).alias("hit_rate_10"))


def blended_pace(games: DataFrame) -> DataFrame:
    """Team and opponent pace over ten earlier team games, blended with the total of both."""
    t = games.groupBy("team_id", "game_id", "opponent_team_id", "game_date", "start_time").agg(F.sum("pra").cast("double").alias("pace"))
    ids = ["team_id", "game_id"]
    own = sliced_means(t, ["team_id"], {"a": ("pace", 10)}, ids)
    other = sliced_means(t, ["opponent_team_id"], {"b": ("pace", 10)}, ids)
    t = own.join(other, ids).na.fill(0.0, ["a", "b"])
    return t.select("team_id", "game_id", (0.45 * F.col("a") + 0.45 * F.col("b") + 0.10 * (F.col("a") + F.col("b")) / 4.8).alias("blended_pace"))


def profile_bucket(players: DataFrame) -> DataFrame:
    """Quartile 0 to 3 of a player's mean minutes within the position."""
    g = players.groupBy("player_id").agg(F.avg("minutes").alias("m"), F.min("position").alias("position"))
    p = places(g, ["position"], ["m", "player_id"], ["player_id"])
    return p.select("player_id", "position", F.least(F.floor((F.col("place") + 1) * 4 / F.col("of")), F.lit(3)).cast("long").alias("bucket"))


def trade_context(games: DataFrame) -> DataFrame:
    """Changes of opponent conference (stand-in for a team change), the stint they begin and games since."""
    w = by("player_id")
    side = (F.col("opponent_team_id") % 2).cast("long")
    g = games.select("player_id", "game_id", "game_date", "start_time", side.alias("side"), F.coalesce(F.lag(side).over(w) != side, F.lit(False)).alias("changed"))
    g = g.withColumn("stint", F.sum(F.col("changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.row_number().over(Window.partitionBy("player_id", "stint").orderBy(*ORDER)) - 1
    return g.select("player_id", "game_id", "changed", "stint", since.cast("long").alias("games_since"), ((F.col("stint") > 0) & (since < 5)).alias("recent_change"))


def return_sessions(games: DataFrame, gap: int = 10) -> DataFrame:
    """Sessions that begin after more than ``gap`` days away; place in the session from 1."""
    w = by("player_id")
    away = F.coalesce(F.datediff("game_date", F.lag("game_date").over(w)) > gap, F.lit(False))
    g = games.select("player_id", "game_id", "game_date", "start_time", away.alias("returned"))
    g = g.withColumn("session", F.sum(F.col("returned").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("player_id", "session").orderBy(*ORDER))
    return g.select("player_id", "game_id", "returned", "session", place.cast("long").alias("game_in_session"))


def date_islands(days: DataFrame, key: str = "team_id", day: str = "game_date") -> DataFrame:
    """Runs of consecutive days of each key."""
    d = days.select(key, day).distinct()
    d = d.withColumn("island", F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(key).orderBy(day))))
    return d.groupBy(key, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("island")


def surrogate_lines(games: DataFrame, markets: tuple[str, ...] = ("points", "assists", "pra"), k: int = 5) -> DataFrame:
    """A line for each market from the mean of the k earlier games, and how the game came out against it."""
    wide = games.select("player_id", "game_id", "game_date", "start_time", *[F.col(m).cast("double").alias(m) for m in markets])
    long = wide.unpivot(["player_id", "game_id", "game_date", "start_time"], list(markets), "market", "actual")
    w = by("player_id", "market")
    f = before(w, k)
    long = long.withColumn("line", F.when(F.count("actual").over(f) >= k, F.avg("actual").over(f))).where("line is not null")
    season = F.year("game_date") - F.when(F.month("game_date") >= 10, 0).otherwise(1)
    return long.select("player_id", "game_id", "market", "line", "actual", (F.col("actual") > F.col("line")).alias("over"), (F.col("actual") == F.col("line")).alias("push"), season.cast("long").alias("season"))


def trailing_baseline(games: DataFrame, n: int = 15, least: int = 10) -> DataFrame:
    """Mean minutes of n earlier games if there are ``least`` of them, else of all; and whether the last or this game followed a long absence."""
    w = by("player_id", "team_id")
    f, m = before(w, n), F.col("minutes")
    away = F.coalesce(F.datediff("game_date", F.lag("game_date").over(w)) > 10, F.lit(False))
    g = games.select("player_id", "game_id", "team_id", "game_date", "start_time", F.coalesce(at_least(m, F.avg(m).over(f), f, least), F.avg(m).over(before(w))).alias("baseline"), away.alias("away"))
    return g.select("player_id", "game_id", "baseline", (F.col("away") | F.coalesce(F.lag("away").over(w), F.lit(False))).alias("excluded"))


def stat_drop_guard(games: DataFrame) -> DataFrame:
    """Games under 5 minutes, or with a stat under half of the mean of the five earlier games (two at least, mean over 1)."""
    w = by("player_id")
    f = before(w, 5)
    low = F.col("minutes") < 5
    for s in ("points", "rebounds", "assists", "threes", "turnovers"):
        x = F.col(s).cast("double")
        mean = at_least(x, F.avg(x).over(f), f, 2)
        low = low | F.coalesce((mean > 1) & (x < 0.5 * mean), F.lit(False))
    return games.select("player_id", "game_id", low.alias("dropped"))


def blended(a5: Column, ewm10: Column, a20: Column, season: Column, role: Column) -> Column:
    """Short and long horizons of a metric, mixed by the stability of the role."""
    return (1 - role) * (0.55 * a5 + 0.45 * ewm10) + role * (0.65 * a20 + 0.35 * season)


def market_group(rows: DataFrame, groups: dict[str, tuple[float, tuple[str, ...]]], most: float = 5.0, of: DataFrame | None = None) -> DataFrame:
    """Adds ``group_<name>``: weight times the mean of its columns, in logs where a column's largest size (of the rows of ``of``, if given) is over ``most``.

    The largest sizes are one row, which is broadcast.
    """
    used = sorted({c for _, columns in groups.values() for c in columns})
    top = (rows if of is None else of).agg(*[F.max(F.abs(F.col(c))).alias(f"_top_{c}") for c in used])
    value = lambda c: F.when(F.col(f"_top_{c}") > most, F.log(1 + F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    d = rows.crossJoin(F.broadcast(top))
    out = {f"group_{k}": F.lit(w) * sum((value(c) for c in columns), F.lit(0.0)) / len(columns) for k, (w, columns) in groups.items()}
    return d.withColumns(out).drop(*[f"_top_{c}" for c in used])
