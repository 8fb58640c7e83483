"""Match records and player profiles against plain definitions, and how all_docs passes over the balls."""

import random
import re
from collections import defaultdict

from wicketlake.operators import aggregates as ag
from wicketlake.plans import documents as plans
from wicketlake.sources import star

SCHEMA = (
    "match_id string, match_date string, season string, match_type string, venue string, city string, match_winner string, inning string, "
    "batting_team string, batter string, bowler string, wicket_player_out string, row_seq long, runs_batter int, extras_wides int, "
    "extras_noballs int, non_boundary int, wicket_count int, wicket_kind string, runs_total int"
)
FIELDS = {"match_date": 1, "season": 2, "match_type": 3, "venue": 4, "city": 5, "winner": 6}


def _balls(n):
    """Balls whose headers, sides and innings change within a match, with ties, blanks and nulls."""
    r = random.Random(11)
    return [
        (
            r.choice(["m1", "m2", "m3", " ", None]), r.choice(["2024-01-01", "2024-01-02", "", "bad", None]), "2024", r.choice(["T20", "ODI", ""]),
            r.choice(["Old", "New", "", None]), "", r.choice(["A", "B", "", None]), r.choice(["1", "2", " 2 ", "", None]),
            r.choice(["A", "B", "", None]), r.choice(["P1", "P2", "P3", "", None]), r.choice(["P1", "P2", "P4", ""]), r.choice(["P1", "P5", "", ""]),
            r.randrange(20), r.choice([0, 1, 4, 6, None]), r.choice([0, 0, 1]), r.choice([0, 0, 1]), r.choice([0, 1]), r.choice([0, 0, 1]),
            r.choice(["bowled", "run out", ""]), r.choice([0, 1, 5, None]),
        )
        for _ in range(n)
    ]


def _plain_records(balls):
    out = {}
    for m in sorted({b[0] for b in balls if b[0] and b[0].strip()}):
        of = [b for b in balls if b[0] == m]
        first = lambda at: min(((b[12], b[at]) for b in of if b[at]), default=(0, ""))[1]
        total = lambda rows, at: None if all(b[at] is None for b in rows) else sum(b[at] or 0 for b in rows)
        legal = lambda rows: sum(b[14] == 0 and b[15] == 0 for b in rows)
        by_inning = defaultdict(list)
        for b in of:
            by_inning[(b[7] or "").strip() or b[8] or "innings"].append(b)
        innings = sorted(
            (min(b[12] for b in rows), key, min(((b[12], b[8]) for b in rows if b[8]), default=(0, ""))[1], total(rows, 19), total(rows, 17), legal(rows))
            for key, rows in by_inning.items()
        )
        sides = [(t, total(rows, 19), legal(rows)) for t in sorted({b[8] for b in of if b[8]}) for rows in [[b for b in of if b[8] == t]]]
        out[m] = ({name: first(at) for name, at in FIELDS.items()}, [i[1:] for i in innings], sides)
    return out


def test_match_records_equal_their_definition(spark):
    for n in (6, 40, 600):
        balls = _balls(n)
        made = ag.match_records(spark.createDataFrame(balls, SCHEMA).repartition(3)).collect()
        got = {r.match_id: ({name: r[name] for name in FIELDS}, [tuple(i) for i in r.innings], [tuple(s) for s in r.sides]) for r in made}
        assert got == _plain_records(balls)


def test_teams_of_match_records_are_match_teams(spark):
    frame = spark.createDataFrame(_balls(300), SCHEMA)
    teams = ag.match_teams(frame)
    assert teams.count() == 6
    assert sorted(map(tuple, teams.collect())) == sorted(map(tuple, ag.teams_of_matches(ag.match_records(frame)).select(*teams.columns).collect()))


def test_players_bat_for_the_side_of_most_balls_and_matches_count_once(spark):
    balls = [b for b in _balls(400) if b[0] and b[0].strip()]
    got = {r.player: (r.team, r.matches, r.balls, r.dismissals) for r in ag.player_profiles(spark.createDataFrame(balls, SCHEMA)).collect()}
    for player in sorted({x for b in balls for x in (b[9], b[10], b[11]) if x}):
        batted = [b for b in balls if b[9] == player]
        place = lambda b: ((b[1] if (b[1] or "").startswith("2") else ""), b[12])
        sides = [(-len(rows), min(map(place, rows)), t) for t in {b[8] for b in batted if b[8]} for rows in [[b for b in batted if b[8] == t]]]
        matches = {b[0] for b in balls if player in (b[9], b[10])}
        assert got[player] == (min(sides)[2] if sides else "", len(matches), sum(b[14] == 0 and b[15] == 0 for b in batted), sum(b[11] == player for b in balls))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_docs_passes_over_the_balls_twice_and_deals_no_totals_out_by_match(spark, monkeypatch):
    monkeypatch.setattr(star, "BALLS_IN_PART", 100)
    balls = star.deliveries(spark, "/root/testdata/sf0.001")
    # totals of players in a match stay where the match is: nothing but players and their sides moves
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\), ENSURE", _plan(ag.player_profiles(balls)))
    assert sorted(re.sub(r"#\d+L?", "", k) for k in keys if not k.startswith("o_custkey") and not k.startswith("c_custkey")) == ["player", "player, team"]
    # one pass for the players is left in the plan; matches and teams come from the records written before
    scans = re.findall(r"FileScan parquet \[.*?l_orderkey", _plan(plans.all_documents(spark, "/root/testdata/sf0.001")))
    assert len(scans) == 1
