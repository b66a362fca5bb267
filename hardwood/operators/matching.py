"""Matching by similarity and by nearness in time, without meeting all pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hardwood.sources.tables import stored


@F.pandas_udf(T.IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, with a string as one integer of bits and a few operations a character."""

    def one(x: str, y: str) -> int:
        masks: dict[str, int] = {}
        for i, c in enumerate(y):
            masks[c] = masks.get(c, 0) | 1 << i
        full = (1 << len(y)) - 1
        v = full
        for c in x:
            u = v & masks.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return len(y) - v.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def similarity(common: Column, a: Column, b: Column) -> Column:
    """``2 * common / (len a + len b)``: one less the share of characters to insert or delete; 1 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def similar_pairs(left: DataFrame, right: DataFrame, least: float, q: int = 2) -> DataFrame:
    """``(left_id, right_id, score)`` of all pairs of ``(id, name)`` whose similarity is ``least`` or more; exact.

    An insertion or deletion spoils q of a string's q-grams at most, so a pair that is alike shares all but
    ``q * d`` of each side's grams, d the most differences that the lengths allow. With grams in one order by
    rarity, the ``q * d + 1`` rarest of both must then have one in common: only those are joined on. Pairs that
    share fewer grams or letters than they must are dropped before any comparison. Names too short for that share a key by
    length instead. A gram's list can be long; the join has both sides' rows for it and Spark splits it by size.
    """

    def grams(d: DataFrame, side: str) -> DataFrame:
        n = F.length("name")
        d = d.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), n.alias("n"))
        letters = F.split(f"{side}_name", "")
        bag = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i), lambda x: x == c)).cast("string")))
        cut = F.when(F.col("n") >= q, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - q + 1, F.lit(1))), lambda i: F.substring(f"{side}_name", i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
        return d.withColumns({"grams": cut, "bag": F.when(F.col("n") > 0, bag).otherwise(F.array().cast("array<string>"))})

    # each occurrence of a gram in a name is a token of its own, so sets of tokens count repeats
    def tokens(d: DataFrame, side: str) -> DataFrame:
        one = d.select(f"{side}_id", F.posexplode("grams").alias("at", "gram"))
        return one.select(f"{side}_id", F.concat_ws("|", "gram", F.row_number().over(Window.partitionBy(f"{side}_id", "gram").orderBy("at")).cast("string")).alias("token"))

    a, b = grams(left, "left"), grams(right, "right")
    ta, tb = tokens(a, "left"), tokens(b, "right")
    seen = ta.select("token").unionByName(tb.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    most = F.ceil(F.col("n") * 2 * (1 - least) / least - F.lit(1e-9)).cast("int")  # differences, of partners of any length allowed

    def prefix(d: DataFrame, t: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(f"{side}_id").orderBy("f", "token")
        ranked = t.join(seen, "token").select(f"{side}_id", "token", F.row_number().over(w).alias("rank"))
        far = d.select(f"{side}_id", "n", (q * most + 1).alias("most"), F.size("grams").alias("m"))
        near = ranked.join(far, f"{side}_id").where("rank <= most").select(f"{side}_id", "token")
        # with no more grams than can be spoilt a partner need share none: such names meet by length
        short = far.where("m < most").select(f"{side}_id", "n")
        return near, short

    pa, sa = prefix(a, ta, "left")
    pb, sb = prefix(b, tb, "right")
    reach = F.sequence(F.floor(F.col("n") * least / (2 - least)).cast("int"), F.ceil(F.col("n") * (2 - least) / least).cast("int"))
    by_length = lambda d, side: d.select(f"{side}_id", "n")
    short_left = sa.select("left_id", F.explode(reach).alias("n")).join(by_length(b, "right"), "n").select("left_id", "right_id")
    short_right = sb.select("right_id", F.explode(reach).alias("n")).join(by_length(a, "left"), "n").select("left_id", "right_id")
    pairs = pa.join(pb, "token").select("left_id", "right_id").unionByName(short_left).unionByName(short_right).distinct()
    both = pairs.join(a.select("left_id", "left_name", F.col("n").alias("n1"), F.col("grams").alias("g1"), F.col("bag").alias("b1")), "left_id").join(b.select("right_id", "right_name", F.col("n").alias("n2"), F.col("grams").alias("g2"), F.col("bag").alias("b2")), "right_id")
    allowed = F.floor((1 - least) * (F.col("n1") + F.col("n2")) + 1e-9)
    enough = F.size(F.array_intersect("g1", "g2")) >= F.size(F.array_distinct("g1")) - q * allowed
    # a common subsequence has no more of a letter than either side
    letters = 2 * F.size(F.array_intersect("b1", "b2")) >= F.col("n1") + F.col("n2") - allowed
    both = both.where((F.abs(F.col("n1") - F.col("n2")) <= allowed) & enough & letters)
    both = both.select("left_id", "right_id", F.col("left_name").alias("x"), F.col("right_name").alias("y")).withColumn("c", common_length("x", "y"))
    return both.select("left_id", "right_id", similarity(F.col("c"), F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least - 1e-12)


def one_apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left_id, right_id, score)`` of all pairs of ``(id, name)`` that one inserted or deleted character makes equal; exact.

    The longer name without that character is the shorter one, so names meet by equality: each side whole with the other side's
    names less one character. Rows are as many as characters, however alike the names are.
    """
    n = F.length("name")
    less = F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.substring("name", i + 1, n))))
    cut = lambda d, side: d.where(n > 0).select(F.col("id").alias(f"{side}_id"), F.explode(less).alias("name"))
    whole = lambda d, side: d.select(F.col("id").alias(f"{side}_id"), "name")
    score = 2.0 * n / (2 * n + 1)  # of the shorter name
    return cut(left, "left").join(whole(right, "right"), "name").unionByName(whole(left, "left").join(cut(right, "right"), "name").select("name", "left_id", "right_id")).select("left_id", "right_id", score.alias("score"))


def resolve_names(wanted: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``(entity_id, player_id, confidence)``: an equal name first (smallest id), else the most similar of all known names, of ``least`` or more.

    Names one character away come next, by equality. Only names for which one that is further away could be as good are
    compared with all known ones: two characters away, the best possible partner is two longer.
    """
    exact = wanted.join(known, "name").groupBy("entity_id").agg(F.min("player_id").alias("player_id")).withColumn("confidence", F.lit(1.0))
    rest = stored(wanted.join(exact.select("entity_id"), "entity_id", "left_anti").select(F.col("entity_id").alias("id"), "name"))
    known = known.select(F.col("player_id").alias("id"), "name")
    top = lambda pairs: pairs.groupBy("left_id").agg(F.max(F.struct("score", (-F.col("right_id")).alias("p"))).alias("m"))
    near = stored(top(one_apart(rest, known).where(F.col("score") >= least - 1e-12)))
    open_ = stored(rest.join(near.select(F.col("left_id").alias("id"), "m.score"), "id", "left").where(F.col("score").isNull() | (F.col("score") <= 1 - 1 / (F.length("name") + 1.0) + 1e-12)).select("id", "name"))
    if not open_.isEmpty():
        near = near.join(open_.select(F.col("id").alias("left_id")), "left_id", "left_anti").unionByName(top(similar_pairs(open_, known, least)))
    return exact.unionByName(near.select(F.col("left_id").alias("entity_id"), (-F.col("m.p")).alias("player_id"), F.col("m.score").alias("confidence")))


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, right_id: str, seconds: int) -> DataFrame:
    """``left`` with the id of the row of ``right`` of equal keys that lies nearest in time, ``seconds`` away at most, and how far; equally near: the smallest id.

    Of right rows at one time only the smallest id can be the answer, so each time counts once. Time is cut into buckets of
    ``seconds``. A left row meets its own bucket and its two neighbours by equality, so no pair further apart than two
    buckets is formed, and of the earlier bucket only its last time, of the later one its first. Left rows are rows of a table with unique values in all columns taken together.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    l_ = left.select("*", F.explode(F.array(*[F.struct((bucket(left_at) + k).alias("_b"), F.lit(k).alias("_side")) for k in (-1, 0, 1)])).alias("_x")).select(*left.columns, "_x._b", "_x._side")
    r = right.groupBy(*keys, F.col(right_at).alias("_at")).agg(F.min(right_id).alias("_id")).withColumn("_b", bucket("_at"))
    ends = r.groupBy(*keys, "_b").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    end = r.join(ends, [*keys, "_b"])
    r = end.select(*keys, "_b", "_id", "_at", F.explode(F.array_compact(F.array(F.lit(0), F.when(F.col("_at") == F.col("_last"), -1), F.when(F.col("_at") == F.col("_first"), 1)))).alias("_side"))
    away = F.abs(F.unix_micros(F.col(left_at).cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp")))
    j = l_.join(r, [*keys, "_b", "_side"]).withColumn("_away", away).where(F.col("_away") <= seconds * 1_000_000)
    best = j.groupBy(*left.columns).agg(F.min(F.struct("_away", "_id")).alias("_m"))
    return best.select(*left.columns, F.col("_m._id").alias(right_id), (F.col("_m._away") / 1e6).alias("seconds_away"))


def retrieve(queries: DataFrame, examples: DataFrame, k: int) -> DataFrame:
    """``(query_id, example_id, score, rank)``: the k best examples of each query, older ones first among equals.

    Queries ``(query_id, market, bucket)`` and examples ``(example_id, player_id, market, line, day, real)``. A score has 3
    for the query's half-point line bucket, 1 for a bucket within a point, 2 for a real example; equal (player, market,
    day, line) count once, the smallest id. Examples lie in lists by (market, bucket, real), each cut to its k oldest
    by day and id, as no other can be among the k best of any query. What is best depends on a query's market and bucket
    only, so it is found once for each that occurs, from the lists that can score, and handed to its queries; those
    answers are as few as markets and buckets, and are broadcast.
    """
    one = examples.groupBy("player_id", "market", "day", "line").agg(F.min(F.struct((~F.col("real")).alias("made"), "example_id")).alias("e")).select("market", "line", "day", "e.example_id", (~F.col("e.made")).alias("real"))
    one = one.withColumn("bucket", F.floor(F.col("line") * 2) / 2)
    w = Window.partitionBy("market", "bucket", "real").orderBy("day", "example_id")
    lists = one.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k", "line")
    asked = queries.select("market", F.col("bucket").alias("want")).distinct()
    # by distance of buckets: 0, up to 1, further; the last kind scores for real examples only
    near = asked.select("market", "want", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.col("want") + i / 2)).alias("bucket"))
    close = near.join(lists, ["market", "bucket"]).select("market", "want", "example_id", "day", (F.when(F.col("bucket") == F.col("want"), 3).otherwise(1) + F.col("real").cast("int") * 2).alias("score"))
    w = Window.partitionBy("market").orderBy("day", "example_id")
    # five buckets are near, of k examples each, so the 6 k oldest hold the k oldest of those further away
    far = lists.where("real").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 6 * k).drop("_k")
    far = asked.join(far, "market").where("abs(bucket - want) > 1").select("market", "want", "example_id", "day", F.lit(2).alias("score"))
    rank = F.row_number().over(Window.partitionBy("market", "want").orderBy(F.desc("score"), "day", "example_id"))
    best = close.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k).select("market", F.col("want").alias("bucket"), "example_id", "score", "rank")
    return queries.join(F.broadcast(best), ["market", "bucket"]).select("query_id", "example_id", "score", "rank")
