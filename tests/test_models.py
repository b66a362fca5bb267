"""Folds, calibration, bootstrap, matching and mixtures against plain versions."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.operators import context, matching, mixtures, validation
from hardwood.plans.model_queries import event_games, paired
from hardwood.sources.roles import predictions

SF = "/root/testdata/sf0.01"


def test_no_row_is_scored_by_a_fit_that_saw_it_or_its_week(spark):
    p = predictions(spark, SF)
    rows, folds = validation.purged_folds(p, ["player_id", "game_id"], "game_date", ["game_id", "player_id"])
    first = {r.fold: r.first_day for r in folds.collect()}
    n = 0
    for r in rows.collect():
        if r.valid_fold is not None and r.train_from is not None:
            assert r.train_from > r.valid_fold
        if r.train_from is not None:
            assert (first[r.train_from] - r.game_date).days > 7
            assert r.train_from == 0 or (first[r.train_from - 1] - r.game_date).days <= 7
        n += r.valid_fold is not None
    assert n > 0.9 * p.count()


def test_calibration_moves_only_with_earlier_rows(spark):
    rnd = random.Random(1)
    rows = [(k, date(2020, 1, 1) + timedelta(k // 4), p := rnd.random(), int(rnd.random() < p * p)) for k in range(2400)]
    df = spark.createDataFrame(rows, "id long, day date, p double, y int")

    def run(d):
        f, t = validation.purged_folds(d, ["id"], "day", ["id"])
        return {r.id: (r.calibrated, r.method) for r in validation.out_of_fold(d.select("id", "p", "y").join(f, "id"), t).collect()}

    base = run(df)
    late = run(df.withColumn("y", F.when(F.col("id") >= 1800, 1 - F.col("y")).otherwise(F.col("y"))))
    assert all(base[k] == late[k] for k in base if k < 1800) and any(base[k] != late[k] for k in base)
    y = {k: v for k, _, _, v in rows}
    p = {k: v for k, _, v, _ in rows}
    brier = lambda f: np.mean([(f(k) - y[k]) ** 2 for k in base if k > 600])
    assert brier(lambda k: base[k][0]) < brier(lambda k: p[k]) - 0.01
    assert run(df.where("id < 100")) == {}


def test_isotonic_against_pool_adjacent_violators(spark):
    rnd = random.Random(2)
    bins = [(0, b, n := rnd.randrange(0, 9), rnd.randrange(n + 1)) for b in range(40)]
    got = {r.bin: r.value for r in validation.isotonic(spark.createDataFrame(bins, "k int, bin int, n long, hits long"), ["k"]).collect()}
    pools = []
    for _, b, n, h in bins:
        if n:
            pools.append([h, n, [b]])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                h2, n2, b2 = pools.pop()
                pools[-1] = [pools[-1][0] + h2, pools[-1][1] + n2, pools[-1][2] + b2]
    want = {b: h / n for h, n, bs in pools for b in bs}
    assert got == pytest.approx(want)


def test_bootstrap_against_resampling(spark):
    d = paired(spark, SF).toPandas()
    rmse = lambda c: F.sqrt(F.col(c) / F.col("n"))
    got = validation.bootstrap(paired(spark, SF), "player_id", [], {"n": F.lit(1), "off": F.col("off"), "full": F.col("full")}, rmse("off") - rmse("full"), replicates=600).first()
    per = d.groupby("player_id").agg(n=("off", "size"), off=("off", "sum"), full=("full", "sum")).to_numpy()
    rng = np.random.default_rng(1)
    deltas = []
    for _ in range(2000):
        n, off, full = per[rng.integers(0, len(per), len(per))].sum(0)
        deltas.append((off / n) ** 0.5 - (full / n) ** 0.5)
    low, mid, high = np.quantile(deltas, [0.025, 0.5, 0.975])
    scale = (d["off"].mean()) ** 0.5
    assert abs(got.q_25 - low) < 0.02 * scale and abs(got.q_500 - mid) < 0.02 * scale and abs(got.q_975 - high) < 0.02 * scale
    assert abs((got.q_975 - got.q_25) / (high - low) - 1) < 0.2
    w = spark.range(2000).select(F.explode(validation.poisson_weights(F.col("id"), 50)).alias("w")).toPandas()["w"]
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.8, 0.9, 0.97])
def test_similar_pairs_are_all_pairs(spark, least):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 3, 6, 12, 18, 90]))) for _ in range(40)]

    def edit(x):
        x = list(x)
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(x) + 1)
            x[k : k + rnd.randrange(2)] = rnd.choice(["", "a", "b"])
        return "".join(x)

    left, right = [(k, x) for k, x in enumerate(base)] + [(50, "")], [(k, edit(x)) for k, x in enumerate(base * 2)] + [(100, ""), (101, "é")]
    frame = lambda d: spark.createDataFrame(d, "id long, name string")
    got = {(r.left_id, r.right_id): r.score for r in matching.similar_pairs(frame(left), frame(right), least).collect()}
    score = lambda a, b: 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
    want = {(i, j): s for i, a in left for j, b in right if (s := score(a, b)) >= least - 1e-12}
    assert got == pytest.approx(want)


def test_nearest_in_time(spark):
    rnd = random.Random(4)
    t = lambda: datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(40_000))
    left, right = [(i, rnd.randrange(3), t()) for i in range(200)], [(i, rnd.randrange(3), t()) for i in range(150)]
    got = {r.l: (r.r, r.seconds_away) for r in matching.nearest_within(spark.createDataFrame(left, "l long, k int, a timestamp"), spark.createDataFrame(right, "r long, k int, b timestamp"), ["k"], "a", "b", "r", 600).collect()}
    want = {}
    for i, k, a in left:
        near = sorted((abs((a - b).total_seconds()), j) for j, m, b in right if m == k and abs((a - b).total_seconds()) <= 600)
        if near:
            want[i] = (near[0][1], near[0][0])
    assert got == want
    plan = event_games(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_retrieval_against_a_full_sort(spark):
    rnd = random.Random(5)
    ex = [(i, rnd.randrange(4), rnd.choice("ab"), float(rnd.randrange(8)) / 2, date(2024, 1, 1) + timedelta(rnd.randrange(30)), rnd.random() < 0.5) for i in range(600)]
    qs = [(q, m, b / 2) for q, m, b in ((1, "a", 3), (2, "b", 0), (3, "a", 7), (4, "c", 1), (5, "a", 40))]
    got = matching.retrieve(spark.createDataFrame(qs, "query_id long, market string, bucket double"), spark.createDataFrame(ex, "example_id long, player_id long, market string, line double, day date, real boolean"), 25).collect()
    one = {}
    for e in sorted(ex, key=lambda e: (not e[5], e[0])):
        one.setdefault((e[1], e[2], e[4], e[3]), e)
    want = set()
    for q, m, b in qs:
        score = lambda e: (3 if e[3] == b else 1 if abs(e[3] - b) <= 1 else 0) + 2 * e[5]  # noqa: B023, E731
        hits = sorted((-score(e), e[4], e[0]) for e in one.values() if e[2] == m and score(e))
        want |= {(q, i, -s, r) for r, (s, _, i) in enumerate(hits[:25], 1)}
    assert {(r.query_id, r.example_id, r.score, r["rank"]) for r in got} == want


def test_more_doubtful_players_than_can_be_enumerated(spark):
    doubts = spark.createDataFrame([(1, 1, p, 0.3 if p % 2 else 0.8, 10.0) for p in range(12)] + [(2, 1, 5, 0.25, 4.0)], "game_id long, team_id long, player_id long, p_play double, usage double")
    b = mixtures.branch_frames(spark.createDataFrame([(1, 1), (2, 1), (3, 7)], "game_id long, team_id long"), doubts).toPandas()
    many = b[b.game_id == 1]
    assert len(many) == 2048 and many.probability.sum() == pytest.approx(1) and many.absent.mean() == pytest.approx(6 * 0.7 + 6 * 0.2, abs=0.15) and (many.lost == many.absent * 10).all()
    assert sorted(b[b.game_id == 2][["probability", "absent", "lost"]].itertuples(index=False, name=None)) == [(0.25, 0, 0.0), (0.75, 1, 4.0)]
    assert b[b.game_id == 3][["branch", "probability", "absent"]].values.tolist() == [[0, 1.0, 0]]


def test_mixture_quantiles_against_draws(spark):
    rows = [(1, 0.5, 4.0, 4.0, 6.0), (1, 0.3, 9.0, 20.0, 6.0), (1, 0.2, 2.0, 2.05, 6.0), (2, 0.0, 3.0, 3.0, 2.5), (2, -1.0, 7.0, 7.0, 2.5)]
    got = {r.k: r for r in mixtures.branch_mixture(spark.createDataFrame(rows, "k long, weight double, mean double, variance double, line double"), ["k"]).collect()}
    rng = np.random.default_rng(3)
    draw = lambda m, v, n: rng.poisson(m, n) if v <= 1.05 * m else rng.negative_binomial(m * m / (v - m), m / v, n)
    x = np.concatenate([draw(4, 4, 250_000), draw(9, 20, 150_000), draw(2, 2.05, 100_000)])
    r = got[1]
    assert r.mean == pytest.approx(x.mean(), rel=0.01) and r.variance == pytest.approx(x.var(), rel=0.02) and r.over_probability == pytest.approx((x > 6).mean(), abs=0.005)
    assert [r.p10, r.p25, r.p50, r.p75, r.p90] == [int(np.quantile(x, q, method="inverted_cdf")) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
    assert got[2].mean == 5.0


def test_a_variance_of_exactly_the_threshold_is_poisson(spark):
    from hardwood.operators import trading

    # 120 / 9 and 14, as sums in another order give it: a hair more than 1.05 means
    rows = spark.createDataFrame([(1, 13.333333333333334, 14.000000000000004, 13.5, 0.0), (2, 13.333333333333334, 14.0, 13.5, 0.0)], "quote_id long, mean double, variance double, line double, dnp double")
    assert {r.family for r in rows.select(*trading.count_distribution()).collect()} == {"poisson"}
    for got in (mixtures.prop_tails(rows), mixtures.dnp_mixture(rows), mixtures.branch_mixture(rows.selectExpr("quote_id", "1D as weight", "mean", "variance", "line"), ["quote_id"])):
        a, b = sorted(got.collect())
        assert abs(a.over_probability - b.over_probability) < 1e-12


def test_nearest_within_forms_few_pairs_where_many_games_share_a_time(spark):
    day = datetime(2024, 1, 1)
    left = spark.createDataFrame([(i, 1, day + timedelta(hours=i % 3)) for i in range(300)], "l long, k int, a timestamp")
    right = spark.createDataFrame([(1000 - i, 1, day + timedelta(seconds=600 * (i % 2))) for i in range(300)], "r long, k int, b timestamp")
    best = matching.nearest_within(left, right, ["k"], "a", "b", "r", 7200)
    assert {r.l: r.r for r in best.collect()} == {i: (702, 701, 701)[i % 3] for i in range(300)}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "min(r#" in plan  # a time's games are one row before the join


def test_bootstrap_draws_a_cluster_s_weights_once(spark):
    rows = spark.createDataFrame([(k, c, 1.0) for k in range(3) for c in range(4)], "k long, c long, v double")
    got = validation.bootstrap(rows, "c", ["k"], {"n": F.lit(1), "v": F.col("v")}, F.col("v") / F.col("n"), replicates=9)
    assert {r.k for r in got.collect()} == {0, 1, 2} and all(r.q_500 == 1.0 for r in got.collect())
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()  # all of a cluster's keys in one row


def test_names_one_character_away_meet_by_equality(spark, monkeypatch):
    """names that differ in one character alone never come to the comparison of all names."""
    known = [(k, f"customer {k:06d}") for k in range(400)]
    wanted = [(k, f"custmer {k:06d}") for k in range(1, 400, 7)] + [(1000, "customer 000005"), (1001, "customerr 000006")]
    frame = lambda d, i: spark.createDataFrame(d, f"{i} long, name string")
    monkeypatch.setattr(matching, "similar_pairs", None)
    got = {r.entity_id: (r.player_id, r.confidence) for r in matching.resolve_names(frame(wanted, "entity_id"), frame(known, "player_id"), 0.9).collect()}
    assert got == {k: (k, 28 / 29) for k in range(1, 400, 7)} | {1000: (5, 1.0), 1001: (6, 30 / 31)}


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_resolved_names_are_the_best(spark, least):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 3, 5, 9])))
    wanted, known = [(k, word()) for k in range(40)], [(k, word()) for k in range(25)]
    score = lambda a, b: 2 * lcs(a, b) / (len(a) + len(b))
    want = {}
    for e, a in wanted:
        s, p = max((score(a, b), -k) for k, b in known)
        if s >= least:
            want[e] = (-p, s)
    frame = lambda d, i: spark.createDataFrame(d, f"{i} long, name string")
    assert {r.entity_id: (r.player_id, r.confidence) for r in matching.resolve_names(frame(wanted, "entity_id"), frame(known, "player_id"), least).collect()} == want


def test_post_hoc_absences_shuffle_no_dealt_days(spark):
    """days are dealt within a player's task; results as by every pair of day and appearance."""
    rnd = random.Random(9)
    first = date(2024, 1, 1)
    rows = [(rnd.randrange(2), rnd.randrange(12), first + timedelta(rnd.randrange(90)), rnd.choice([None, 6.0, 11.0, 12.0, 20.0])) for _ in range(160)]
    d = context.post_hoc_absences(spark.createDataFrame(rows, "team_id long, player_id long, game_date date, minutes double"))
    want = {}
    for t, day in {(r[0], r[2]) for r in rows}:
        for p in {r[1] for r in rows if r[0] == t}:
            near = [r for r in rows if r[:2] == (t, p) and timedelta(1) <= day - r[2] <= timedelta(21)]
            m = [r[3] for r in near if r[3] is not None]
            if m and sum(m) / len(m) >= 12 and not any(r[:3] == (t, p, day) for r in rows):
                want[(t, day, p)] = (sum(m) / len(m), max(r[2] for r in near))
    assert {(r.team_id, r.day, r.player_id): (r.baseline, r.last_seen) for r in d.collect()} == want and len(want) > 50
    plan = d._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0:].split("Generate")[0]
    assert "Exchange hashpartitioning" not in above


def test_examples_are_ranked_once_for_a_market_and_bucket(spark):
    """queries of one market and bucket share one answer, so no window runs over queries."""
    ex = [(k, k, "m", float(k % 40), date(2024, 1, 1) + timedelta(k % 9), k % 4 != 0) for k in range(300)]
    examples = spark.createDataFrame(ex, "example_id long, player_id long, market string, line double, day date, real boolean")
    queries = spark.createDataFrame([(k, "m", float(k % 3)) for k in range(600)], "query_id long, market string, bucket double")
    d = matching.retrieve(queries, examples, 8)
    d.collect()
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "query_id" not in "".join(x for x in plan.split("\n") if "Window" in x)
    by = {}
    for r in d.collect():
        by.setdefault(r.query_id, set()).add((r.rank, r.example_id, r.score))
    assert len(by) == 600 and all(by[k] == by[k % 3] and len(by[k]) == 8 for k in by)


def test_moments_are_exact_in_any_order(spark):
    import random
    from fractions import Fraction

    from pyspark.sql import functions as F

    from hardwood.functions.rates import moments

    rng = random.Random(4)
    groups = {k: [rng.randrange(60) for _ in range(rng.randrange(1, 40))] for k in range(60)}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k long, x long").groupBy("k").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    mean, variance = moments(F.col("n"), F.col("s"), F.col("q"))
    for r in df.select("k", mean.alias("mean"), variance.alias("variance")).collect():
        v = groups[r.k]
        n, s, q = len(v), sum(v), sum(x * x for x in v)
        assert r.mean == float(Fraction(s, n)) and r.variance == (float(Fraction(n * q - s * s, n * (n - 1))) if n > 1 else None)


def test_branches_of_equal_moments_and_branches_alone_give_the_mixtures_quantiles(spark):
    import math

    from hardwood.operators import mixtures

    games = {1: [(1.0, 6.0)], 2: [(0.25, 4.0), (0.25, 4.0), (0.5, 9.0)], 3: [(0.0, 3.0)]}
    rows = spark.createDataFrame([(g, w, m, m, 5.5) for g, b in games.items() for w, m in b], "g long, weight double, mean double, variance double, line double")
    out = mixtures.branch_mixture(rows, ["g"])
    for r in out.collect():
        b = [(w or 1.0, m) for w, m in games[r.g]]
        f = [sum(w * sum(math.exp(-m) * m**i / math.factorial(i) for i in range(k + 1)) for w, m in b) for k in range(60)]
        assert [r[f"p{q}"] for q in (10, 25, 50, 75, 90)] == [next(k for k in range(60) if f[k] >= q / 100) for q in (10, 25, 50, 75, 90)] and r.branches == len(b)
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()  # a game of one branch is not dealt out by counts
