"""Raw match files: folders, malformed files, revisions, flattening and the manifest."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wicketlake.operators import aggregates as ag
from wicketlake.sources import matches as mt
from wicketlake.sources.reference_data import read_aliases, read_knowledge


def ball(batter, bowler, runs=0, total=None, **more):
    extras = more.pop("extras", None)
    out = {
        "batter": batter, "bowler": bowler, "non_striker": "N",
        "runs": {"batter": runs, "extras": sum((extras or {}).values()), "total": runs + sum((extras or {}).values()) if total is None else total},
    }
    if extras:
        out["extras"] = extras
    out.update(more)
    return out


def match(teams, innings, winner="", revision=1, match_id=None, **info):
    meta = {"revision": revision, "data_version": "1.0"}
    if match_id:
        meta["match_id"] = match_id
    body = {"dates": ["2024-03-02", "2024-03-01"], "season": 2024, "match_type": "T20", "venue": " Old  Park ", "teams": teams}
    if winner:
        body["outcome"] = {"winner": winner}
    body.update(info)
    return {
        "meta": meta,
        "info": body,
        "innings": [{"team": t, "overs": [{"over": n, "deliveries": d} for n, d in enumerate(overs)]} for t, overs in innings],
    }


M1 = match(
    ["Reds", "Blues"],
    [
        ("Reds", [[
            ball("Ann", "Zed", 4), ball("Ann", "Zed", 4, non_boundary=True), ball("Ann", "Zed", 6),
            ball("Ann", "Zed", 0, extras={"wides": 1}), ball("Ann", "Zed", 1, extras={"noballs": 1}),
            ball("Bob", "Zed", 0, extras={"byes": 2}), ball("Bob", "Zed", 0, extras={"legbyes": 1}),
            ball("Bob", "Zed", 0, wickets=[{"player_out": "Bob", "kind": "caught", "fielders": [{"name": "Yan"}, {"name": "Xi"}]}]),
        ]]),
        ("Blues", [[ball("Zed", "Ann", 2)], [ball("Zed", "Bob", 1)]]),
    ],
    "Reds", 1, "m1",
)
M2 = match(
    ["Reds", "Greens"],
    [("Greens", [[ball("Gus", "Ann", 0, wickets=[{"player_out": "Gus", "kind": "run out"}, {"player_out": "Hal", "kind": "bowled", "fielders": ["Ann"]}])]])],
    match_id="m2",
)
M3 = match(
    ["Blues", "Greens"],
    [("Blues", [[ball("Zed", "Gus", 0, wickets=[{"player_out": "Ivy", "kind": "retired hurt"}], review={"by": "Blues"}, replacements={"match": []}), ball("Zed", "Gus", 3, review={})]])],
    "Greens", match_id="m3",
)
M4 = {k: v for k, v in match([], [("Reds", [[ball("Ann", "Gus", 1)]])]).items()}
M4["info"].pop("teams")
M4["info"]["players"] = {"Reds": ["Ann"], "Blues": ["Zed"]}
M5 = match(["Reds", "Blues"], [], match_id="m5")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("in") / "Datasets"
    revised = json.loads(json.dumps(M1))
    revised["meta"]["revision"] = 2
    revised["info"]["city"] = "Springfield"
    files = {
        "t20/m1.json": M1, "world/m1.json": revised, "t20/m2.json": M2, "t20/deep/m3.json": M3, "world/m4.json": M4,
        "world/m5.json": M5, "all_json/x.json": M1, ".hid/x.json": M1, "t20_csv/x.json": M1,
    }
    for name, body in files.items():
        os.makedirs(base / os.path.dirname(name), exist_ok=True)
        (base / name).write_text(json.dumps(body, indent=1))
    (base / "t20" / "bad.json").write_text('{"meta": {')
    return str(base)


@pytest.fixture(scope="module")
def files(spark, root):
    return mt.read_matches(spark, root).cache()


@pytest.fixture(scope="module")
def selected(files):
    return mt.latest_revisions(mt.with_identity(mt.readable(files))).cache()


@pytest.fixture(scope="module")
def rows(selected):
    return mt.flatten(selected).cache()


def test_folders_and_quarantine(files):
    found = {(r.source_folder, r.path.rsplit("/", 1)[-1]) for r in files.collect()}
    assert found == {
        ("t20", "m1.json"), ("t20", "m2.json"), ("t20", "m3.json"), ("t20", "bad.json"),
        ("world", "m1.json"), ("world", "m4.json"), ("world", "m5.json"),
    }
    assert [r.path.rsplit("/", 1)[-1] for r in mt.quarantined(files).collect()] == ["bad.json"]


def test_latest_revision_wins(selected):
    picked = {r.match_id: (r.source_folder, r.revision) for r in selected.collect()}
    assert picked == {"m1": ("world", 2), "m2": ("t20", 1), "m3": ("t20", 1), "m4": ("world", 1), "m5": ("world", 1)}


def test_flat_rows(rows):
    first = rows.filter("match_id = 'm1'").orderBy("row_seq").collect()
    assert len(first) == 10
    assert [r.non_boundary for r in first[:3]] == [0, 1, 0]
    assert (first[3].extras_wides, first[4].extras_noballs, first[5].extras_byes, first[6].extras_legbyes) == (1, 1, 2, 1)
    assert (first[7].wicket_player_out, first[7].wicket_kind, first[7].wicket_fielders) == ("Bob", "caught", "Yan; Xi")
    assert (first[0].match_date, first[0].season, first[0].venue, first[0].city) == ("2024-03-01", "2024", "Old Park", "Springfield")
    assert [r.ball_id for r in first[8:]] == ["0.1", "1.1"]
    assert (first[8].inning, first[8].batting_team) == (2, "Blues")


def test_primary_wicket_prefers_credited(rows):
    r = rows.filter("match_id = 'm2'").first()
    assert (r.wicket_count, r.wicket_player_out, r.wicket_kind, r.wicket_fielders) == (2, "Hal", "bowled", "Ann")


def test_review_and_replacement_flags(rows):
    flags = [(r.has_review, r.has_replacements) for r in rows.filter("match_id = 'm3'").orderBy("row_seq").collect()]
    assert flags == [(1, 1), (0, 0)]


def test_profiles(rows):
    p = {r.player: r for r in ag.player_profiles(rows).collect()}
    ann = p["Ann"]
    # 4 + 4 + 6 + 1 in m1 and 1 in m4; wide and no-ball are no balls faced.
    assert (ann.runs, ann.balls, ann.fours, ann.sixes, ann.matches, ann.team) == (16, 4, 1, 1, 3, "Reds")
    zed = p["Zed"]
    assert (zed.wickets, zed.bowling_balls, zed.runs_conceded) == (1, 6, 17)
    assert (p["Ivy"].matches, p["Ivy"].dismissals, p["Ivy"].team) == (0, 1, "")
    assert ann.average == 16.0 and ann.strike_rate == 400.0 and zed.economy == 17.0
    assert p["Gus"].role == "Batter"


def test_teams_and_matches(rows):
    teams = {r.team: r for r in ag.team_summaries(rows).collect()}
    assert (teams["Reds"].matches, teams["Reds"].wins, teams["Reds"].no_result) == (2, 1, 1)
    assert (teams["Blues"].matches, teams["Blues"].losses) == (2, 2)
    # The winner Greens did not bat in m3 and gets no match for it.
    assert (teams["Greens"].matches, teams["Greens"].wins) == (1, 0)
    for t in teams.values():
        assert t.wins + t.losses + t.no_result == t.matches
    total = rows.agg(F.sum("runs_total")).first()[0]
    assert sum(t.runs for t in teams.values()) == total
    m1 = ag.match_summaries(rows).filter("match_id = 'm1'").first()
    assert m1.teams == ["Blues", "Reds"]
    assert [(i.inning_key, i.team, i.runs, i.wickets, i.balls) for i in m1.innings] == [("1", "Reds", 20, 1, 6), ("2", "Blues", 3, 0, 2)]


def test_team_list_from_players(spark):
    df = spark.createDataFrame([(None, {"Reds": ["a"], "Blues": ["b"]}), (["B ", "A"], {"X": ["x"]})], "teams array<string>, players map<string,array<string>>")
    got = [r[0] for r in df.select(mt.team_list("teams", "players")).collect()]
    assert got == [["Blues", "Reds"], ["A", "B"]]


def test_manifest_and_counters(files, selected, rows):
    counters = {r.source_folder: r for r in mt.source_counters(files, selected, rows).collect()}
    assert (counters["t20"].json_files_found, counters["t20"].selected_match_files, counters["t20"].skipped_files, counters["t20"].duplicate_files) == (4, 2, 1, 1)
    assert (counters["world"].json_files_found, counters["world"].selected_match_files, counters["world"].duplicate_files) == (3, 3, 0)
    m = mt.dataset_manifest(files, selected, rows).first()
    assert (m.files_discovered, m.files_selected, m.files_skipped, m.duplicate_files) == (7, 5, 1, 1)
    assert (m.rows_written, m.matches_with_rows, m.matches_without_rows) == (14, 4, 1)
    assert (m.deliveries_with_wickets, m.deliveries_with_reviews, m.deliveries_with_replacements) == (3, 1, 1)
    assert m.data_versions == {"1.0": 5} and m.match_types == ["T20"] and len(m.errors) == 1


def test_store_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "deliveries")
    mt.write_deliveries(rows, path)
    back = mt.read_deliveries(spark, path)
    assert back.count() == rows.count()
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_files_in_the_root_are_one_source(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(M2))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.json").write_text(json.dumps(M3))
    got = mt.read_matches(spark, str(tmp_path)).collect()
    assert [r.source_folder for r in got] == [tmp_path.name]


def test_source_folders_of_odd_paths(spark, tmp_path):
    """A folder name that repeats in the path, blanks and a plus sign in names; planning runs no job."""
    root = tmp_path / "data" / "in put" / "data"
    for folder in ("data", "test matches", "a+b", ".hidden", "x_csv"):
        (root / folder / "data").mkdir(parents=True)
        (root / folder / "data" / f"{len(folder)} m.json").write_text(json.dumps(M2))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    frame = mt.read_matches(spark, str(root) + "/")
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == set(jobs)
    assert sorted(r.source_folder for r in frame.select("source_folder").collect()) == ["a+b", "data", "test matches"]


def test_reference_data(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([
        {"id": "r1", "title": "Rule", "answer": "Yes", "aliases": [" a ", "a", ""], "keywords": ["k"]},
        {"id": "", "title": "none", "answer": "x"},
    ]))
    entries = read_knowledge(spark, [str(tmp_path / "a.json")]).collect()
    assert [(e.id, e.category, e.aliases) for e in entries] == [("r1", "general", ["a"])]
    (tmp_path / "alias.json").write_text(json.dumps({"A. Person": "Ann Person", "a person": "Ann Person"}))
    got = {r.alias_norm: r.canonical for r in read_aliases(spark, str(tmp_path / "alias.json")).collect()}
    assert got == {"a person": "Ann Person", "ann person": "Ann Person"}


def _dealt_by(df):
    import re

    return re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


def test_balls_are_dealt_out_by_match_in_parts_of_bounded_size(spark, monkeypatch):
    from wicketlake.operators import boards as bd
    from wicketlake.sources import star

    monkeypatch.setattr(star, "BALLS_IN_PART", 100)
    balls = star.deliveries(spark, "/root/testdata/sf0.001")
    # all steps by match stay in these parts
    dealt = _dealt_by(bd.match_top_performers(balls))
    assert {n for keys, n in dealt if keys.startswith("match_")} == {"60"}
    assert sum(keys.startswith("match_id") for keys, _ in dealt) == 1


def test_archive_summary_groups_no_match_with_names(spark, monkeypatch):
    from wicketlake.operators import aggregates as ag
    from wicketlake.sources import star

    monkeypatch.setattr(star, "BALLS_IN_PART", 100)
    balls = star.deliveries(spark, "/root/testdata/sf0.001")
    dealt = _dealt_by(ag.archive_summary(balls))
    assert {n for keys, n in dealt if keys.startswith("match_")} == {"60"} and not any("day" in keys for keys, _ in dealt)
    assert [tuple(r) for r in ag.archive_summary(balls.filter("match_id = 'none'")).collect()] == [(0, 0, 0, "", "")]
