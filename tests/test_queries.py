"""Every query of the engine against its SQL in DuckDB, and the bare entry points."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from hardwood.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def parts(row):
    """What must be equal, and the floats, which may differ in their last digits."""
    floats = [v for v in row if isinstance(v, float) and not math.isnan(v)]
    return [str(None if isinstance(v, float) and math.isnan(v) else "float" if isinstance(v, float) else v) for v in row], floats


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_sql(spark, tables, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.execute(catalogue.ORACLE[name])
    named = [d[0] for d in want.description]
    assert sorted(named) == columns
    mine = sorted(parts([r[c] for c in columns]) for r in got.collect())
    theirs = sorted(parts([r[named.index(c)] for c in columns]) for r in want.fetchall())
    assert [k for k, _ in mine] == [k for k, _ in theirs]
    assert [x for _, v in mine for x in v] == pytest.approx([x for _, v in theirs for x in v], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_others_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns


def test_targets_meet_markets_by_their_title(spark):
    from hardwood.operators import monitor

    t = [(k, [title], [], ["click"], [10.0], "ev1") for k, title in enumerate(["Player5", "Player61", "zz", "Player7", "Nobody"])] + [(9, ["Player5"], [], ["click"], [99.0], "ev1")]
    targets = spark.createDataFrame(t, "target_id long, title_terms array<string>, player_terms array<string>, stat_terms array<string>, lines array<double>, hint string")
    markets = spark.createDataFrame([(1, "player51 click over", [10.0], "ev1"), (2, "player5 click over", [10.0], "ev2"), (3, "player61 view over", [10.0], "ev1"), (4, "buzz click", [10.0], "ev1"), (5, "zz", [10.0], "ev1"), (6, "player7 click over", [12.0], "ev1")],
                                   "market_id long, text string, lines array<double>, event string")
    best = monitor.score_targets(targets, markets, 100)
    assert {r.target_id: (r.market_id, r.score, r.reasons) for r in best.collect()} == {
        0: (1, 125, "title,stat,line,event"), 1: (None, 0, "stat"), 2: (4, 125, "title,stat,line,event"), 3: (None, 0, "title"), 4: (None, 0, "title"), 9: (None, 0, "no market")}
    assert "_g#" in best._jdf.queryExecution().optimizedPlan().toString()  # not all targets with all markets of a line


def test_lines_of_targets_are_added_in_order_of_snapshots(spark, tmp_path):
    from hardwood.plans.monitor_queries import target_markets

    values = [136.25, 108.3, 104.23, 7.34, 6.4, 79.27, 6.21]  # 63.99... in this order, 64 backwards
    assert math.floor(sum_in(values) / 7) == 63 and math.floor(sum_in(values[::-1]) / 7) == 64
    rows = [(i, 345, "error", x) for i, x in enumerate(values)] + [(90, 3450, "error", 63.5)]
    df = spark.createDataFrame(rows[::-1], "event_id long, user_id long, event_type string, value double")
    df = df.selectExpr("event_id", "timestamp_seconds(event_id) as ts", "user_id", "event_type", "value", "'' as props")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert {r.target_id: r.market_id for r in target_markets(spark, str(tmp_path)).collect()} == {3451: 90, 34501: 90}


def sum_in(values):
    total = 0.0
    for x in values:
        total += x
    return total
