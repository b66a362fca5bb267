import re

from hardwood.sources.roles import reports

SF = "/root/testdata/sf0.001"


def test_reports_meet_players_by_team_and_place(spark):
    plan = reports(spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any(len(re.findall(r"\bi#\d+", line)) == 2 for line in joins)  # the place is a key of both sides, no condition over a team's pairs
