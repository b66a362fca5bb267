from hardwood.operators import trading
from hardwood.operators.trading import parlays
from hardwood.plans import catalogue


def test_parlays_of_all_leg_counts(spark):
    legs = [(b, 100 * b + i, i, i % 3 if b else 0, "mnop"[i % 4], 1.5, 0.5 + i % 7 / 20, 2.0 + i % 5 / 10) for b in (0, 1) for i in range(30)]
    legs += [(1, 500 + i, i, i % 3, "mnop"[i % 4], 1.5, 0.4, 1.5) for i in range(30)]  # the same legs at a lower profit
    kind = "book long, leg_id long, player_id long, game_id long, market_key string, line_value double, p double, price double"
    rows = parlays(spark.createDataFrame(legs, kind), "book", draws=500).collect()
    assert {r.book for r in rows} == {1}  # all of book 0 is one game
    assert {r.leg_count for r in rows} == set(range(3, 21))
    by = {x[1]: x for x in legs}
    for r in rows:
        chosen = [by[int(k)] for k in r.legs.split(",")]
        assert len(chosen) == r.leg_count == len({x[2] for x in chosen}) and len({x[3] for x in chosen}) > 1
        assert max(x[1] for x in chosen) < 500
        if r.leg_count <= 3:
            assert len({x[4] for x in chosen}) == r.leg_count
    assert len({(r.leg_count, r.legs) for r in rows}) == len(rows)


def test_simulated_props_draw_whole_batches(spark, monkeypatch):
    monkeypatch.setattr(trading, "simulate", lambda rows, least=10_000, most=100_000, margin=0.01: (least, most, margin))
    assert catalogue.QUERIES["simulate_props"](spark, "/root/testdata/sf0.001") == (10_000, 100_000, 0.01)


def test_redistribution_is_repeated_sharing(spark):
    import random

    rnd = random.Random(3)
    rows, want = [], {}
    for team in range(40):
        n = rnd.randrange(1, 9)
        mine = [(1, team, i, rnd.randrange(0, 48) / 1.0, rnd.choice([0.0, 1.0, 2.5, 7.0]), rnd.random() < 0.3, rnd.choice([30.0, 40.0, 48.0])) for i in range(n)]
        rows += mine
        left = sum(r[3] for r in mine if r[5])
        new = {r[2]: 0.0 if r[5] else r[3] for r in mine}
        while left > 1e-9:
            can = [r for r in mine if not r[5] and r[4] > 0 and r[6] - new[r[2]] > 1e-9]
            if not can:
                break
            total, used = sum(r[4] for r in can), 0.0
            for r in can:
                gain = min(left * r[4] / total, r[6] - new[r[2]])
                new[r[2]] += gain
                used += gain
            left -= used
        want |= {(team, i): (x, max(left, 0.0) if left > 1e-6 else 0.0) for i, x in new.items()}
    got = trading.redistribute(spark.createDataFrame(rows, "game_id long, team_id long, player_id long, minutes double, weight double, absent boolean, cap double")).collect()
    assert len(got) == len(rows)
    for r in got:
        x, left = want[r.team_id, r.player_id]
        assert abs(r.new_minutes - x) < 1e-6 and abs(r.unplaced - left) < 1e-6


def test_branches_of_large_groups_cover_all_players(spark):
    rows = [(1, i, 0.3) for i in range(50)] + [(2, i, 0.5) for i in range(3)]
    got = trading.branches(spark.createDataFrame(rows, "team long, player_id long, p_play double"), "team").collect()
    large = [r for r in got if r.team == 1]
    assert len(large) == 2048 and abs(sum(r.n_playing for r in large) / 2048 - 15) < 0.5 and abs(sum(r.probability for r in large) - 1) < 1e-9
    small = [r for r in got if r.team == 2]
    assert len(small) == 8 and abs(sum(r.probability for r in small) - 1) < 1e-9


def test_names_fold_all_accents(spark):
    from hardwood.functions.text import normalize_name
    from pyspark.sql import functions as F

    names = {"Nikola Jokić": "nikola jokic", "Dāvis Bertāns": "davis bertans", "Luka Dončić Jr.": "luka doncic", "Ömer Aşık": "omer ask", "Ģirts Ķēniņš": "girts kenins", "O'Neal-Ray III": "o neal ray"}
    got = {r.n: r.x for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", normalize_name(F.col("n")).alias("x")).collect()}
    assert got == names


def test_every_branch_of_a_large_group_draws_each_player_by_a_hash_of_its_own(spark):
    import hashlib

    rows = [(1, k, (k % 9 + 1) / 10) for k in range(1, 13)]
    got = {r.branch: r.n_playing for r in trading.branches(spark.createDataFrame(rows, "team long, player_id long, p_play double"), "team", draws=64).collect()}
    drawn = lambda b, k: int(hashlib.md5(f"branch|1|{b}|{k}".encode()).hexdigest()[:13], 16) / 2**52
    assert got == {b: sum(drawn(b, k) < p for _, k, p in rows) for b in range(64)}
