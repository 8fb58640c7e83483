"""Score pages, infoboxes, provider payloads, documents and streams."""

import json

import pytest
from pyspark.sql import functions as F

from wicketlake.functions import wiki
from wicketlake.operators import vectors as ve
from wicketlake.operators.ordered import numbered
from wicketlake.sources import documents as ds
from wicketlake.sources import feed as fd
from wicketlake.sources import matches as mt
from wicketlake.sources import pages as pg
from wicketlake.streaming import live as lv
from wicketlake.streaming import store

PAGE = """<html><head><title>Reds vs Blues, 1st T20I</title><style>td{}</style>
<script type="application/ld+json">[{"@type": "SportsEvent", "startDate": "2024-03-01", "location": {"name": "Old Park"}}]</script></head>
<body><h1>Reds vs Blues</h1><div class="ds-text-tight-m">Reds 150/3 (20)</div><div class="ci-team-score">Blues 120 (18.2)</div>
<div class="ci-team-score">Reds 150/3 (20)</div><p>Reds won by 30 runs</p>
<h3>Reds Innings</h3><table><thead><tr><th>Batter</th><th>Dismissal</th><th>R</th><th>B</th><th>4s</th><th>6s</th><th>SR</th></tr></thead>
<tr><td>Ann</td><td>not out</td><td>80</td><td>50</td><td>8</td><td>2</td><td>160.0</td></tr>
<tr><td>Bob</td><td>c Yan b Zed</td><td>1,020</td><td>-</td><td></td><td>1</td><td>x</td></tr>
<tr><td>Extras</td><td></td><td>5</td><td></td><td></td><td></td><td></td></tr></table>
<table><tr><th>Bowler</th><th>O</th><th>M</th><th>R</th><th>W</th><th>Econ</th></tr><tr><td>Zed</td><td>4</td><td>0</td><td>30</td><td>1</td><td>7.5</td></tr></table>
<strong>Other</strong><table><tr><th>Batsman</th><th>How out</th><th>R</th></tr><tr><td>Zed</td><td>b Ann</td><td>7</td></tr></table>
<table><tr><td>not</td><td>a scorecard</td></tr></table></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    pages = spark.createDataFrame([(1, "https://example.org/match/123456/full", PAGE), (2, "https://example.org/x", "<p>nothing</p>")], "page_id long, url string, html string")
    return {r.page_id: r for r in pg.extract_scorecards(pages).collect()}, pg.extract_scorecards(pages)


def test_page_fields(page):
    r = page[0][1]
    assert (r.match_id, r.name, r.teams, r.match_type) == ("123456", "Reds vs Blues", ["Reds", "Blues"], "T20I")
    assert (r.status, r.winner, r.venue, r.start_date) == ("Reds won by 30 runs", "Reds", "Old Park", "2024-03-01")
    assert [(s.inning, s.runs, s.wickets, s.overs) for s in r.score] == [("Reds", 150, 3, "20"), ("Blues", 120, 0, "18.2")]
    assert page[0][2].scorecard == [] and page[0][2].teams == []


def test_page_scorecard(page):
    first, second = page[0][1].scorecard
    assert first.inning == "Reds Innings" and second.inning == "Blues Innings"
    assert [(b["name"], b.runs, b.balls, b.sixes, b.strike_rate) for b in first.batting] == [("Ann", 80, 50, 2, 160.0), ("Bob", 1020, 0, 1, 0.0)]
    assert (first.total_runs, first.total_wickets, first.total_overs) == (1100, 1, "4")
    assert [(b["name"], b.wickets, b.runs_conceded) for b in first.bowling] == [("Zed", 1, 30)]
    assert (second.total_runs, second.bowling, second.total_overs) == (7, [], "")


def test_page_becomes_a_match_file(spark, page, tmp_path):
    out = tmp_path / "scraped"
    mt_rows = pg.raw_match_records(page[1].filter("page_id = 1"))
    mt_rows.coalesce(1).write.json(str(out))
    files = mt.with_identity(mt.read_matches(spark, str(out)))
    r = files.first()
    assert (r.match_id, r.revision, r.info.season, r.info.outcome.winner) == ("123456", 1, "2024", "Reds")


WIKI = """Intro {{Infobox cricket team
| name = Reds
| captain = [[Ann Person|Ann]] <ref name="x">note</ref>
| coach = {{flag|{{nested|deep}}}} Bob
| ground = '''Old Park'''
| title1 = [[Indian Premier League|IPL]]
| title1wins = Five ([[2010]])
| title2 = Cup
| title2wins = {{nowrap|1}} 2
| empty =
}}
text"""


def test_infobox(spark):
    pages = spark.createDataFrame([("Reds", WIKI), ("Blues", "no box")], "title string, wikitext string")
    fields = wiki.infobox_fields(pages)
    got = {r.field: r.value for r in fields.collect()}
    assert got["captain"] == "Ann" and got["coach"] == "Bob" and got["ground"] == "Old Park"
    totals = wiki.title_totals(fields).first()
    # "Five (2010)" counts its digits first, as the rule has it.
    assert (totals.major_titles, totals.league_titles) == (2012, 2010)
    teams = spark.createDataFrame([("Reds", 3), ("Blues", 2)], "team string, matches int")
    profile = {r.team: r for r in wiki.team_profile(teams, pages).collect()}
    assert profile["Reds"].captain == "Ann" and profile["Blues"].captain == "" and profile["Blues"].major_titles == 0


def test_scorecard_payload(spark):
    body = [{"inning": "Reds Inning 1", "batting": [{"batsman": {"id": "1", "name": "Ann"}, "dismissal-text": "b Zed", "r": 5, "b": 4, "4s": 1, "6s": 0, "sr": 125.0}], "bowling": [{"bowler": {"name": "Zed"}, "o": 4, "m": 0, "r": 30, "w": 2, "eco": 7.5}]}]
    cards = fd.parse_scorecards(spark.createDataFrame([("m", json.dumps(body))], "id string, scorecard string"))
    bat = fd.batting_lines(cards, "id").first()
    assert (bat.batsman, bat.dismissal_text, bat.runs, bat.fours, bat.strike_rate) == ("Ann", "b Zed", 5, 1, 125.0)
    bowl = fd.bowling_lines(cards, "id").first()
    assert (bowl.bowler, bowl.overs, bowl.wickets, bowl.noballs, bowl.economy) == ("Zed", 4.0, 2, 0, 7.5)


def test_upsert_is_idempotent(spark, tmp_path):
    ddl = "id string, doc_type string, document string, metadata map<string,string>"
    old = spark.createDataFrame([("a", "x", "one", {}), ("b", "x", "two", {})], ddl)
    new = spark.createDataFrame([("b", "x", "new", {}), ("c", "y", "three", {}), ("", "y", "lost", {}), ("d", "y", " ", {})], ddl)
    once = ds.upsert_docs(old, new, [F.desc("document")])
    twice = ds.upsert_docs(once, new, [F.desc("document")])
    assert sorted((r.id, r.document) for r in once.collect()) == [("a", "one"), ("b", "new"), ("c", "three")]
    assert sorted(r.id for r in twice.collect()) == ["a", "b", "c"]
    path = ds.write_docs(once, str(tmp_path))
    back = ds.read_docs(spark, path)
    assert ds.get_docs(back, {"doc_type": "x"}, limit=1, offset=1).first().id == "b"


def test_nearest_vectors_both_ways(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, vector array<double>")
    queries = spark.createDataFrame([(i, [float(i), 2.0, 1.0]) for i in range(9)], "query_id long, vector array<double>")
    a = sorted(map(tuple, ve.knn(queries, vectors, 4).collect()))
    b = sorted(map(tuple, ve.knn(queries, vectors, 4, bound=2).collect()))
    assert a == b and len(a) == 36


def test_near_question_needs_similar_text(spark):
    cache = spark.createDataFrame([("1", "virat kohli average in odi cricket", "50"), ("2", "rohit sharma sixes", "")], "id string, question_text string, answer_text string")
    asked = spark.createDataFrame(
        [("a", "What is Virat Kohli's average in ODI cricket"), ("b", "virat kohli averge in odi cricket"), ("c", "rohit sharma sixes"), ("d", "virat kohli average in odi cricket now")],
        "question_id string, text string",
    )
    got = {r.question_id: (r.cached_id, r.distance) for r in ve.near_hits(asked, cache, 0.25).collect()}
    assert got["a"] == ("1", 0.0)
    assert got["b"] == ("1", 0.2)
    # c has no answer, d is close by its words but its text is not similar enough.
    assert "c" not in got and "d" not in got


def test_cached_questions_of_stop_words_and_stored_responses(spark):
    cache = spark.createDataFrame(
        [("1", "What is the?", "x", None), ("2", "rohit sharma sixes", "", '{"rows": [1]}'), ("3", "dhoni sixes", " ", "not json"), ("4", "kohli sixes", None, "null")],
        "id string, question_text string, answer_text string, response_json string",
    )
    asked = spark.createDataFrame(
        [("a", "what is  THE"), ("b", "sixes of Rohit Sharma"), ("c", "dhoni sixes"), ("d", "kohli sixes"), ("e", "the is what"), ("f", "???")],
        "question_id string, text string",
    )
    assert {r.question_id: r.cached_id for r in ve.exact_hits(asked, cache).collect()} == {"a": "1", "b": "2"}
    # the same words in another order are at distance 0 and similar as texts
    assert {r.question_id: r.cached_id for r in ve.near_hits(asked, cache).collect()} == {"a": "1", "b": "2", "e": "1"}


def test_nearest_question_is_chosen_before_its_test(spark):
    near, far = "virat kohli average in odi cricket", "virat kohli averge in odi cricket now"
    asked = spark.createDataFrame([("a", "virat kohli average in odi cricket now")], "question_id string, text string")
    cached = lambda *texts: spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "id string, question_text string, answer_text string")
    assert [r.cached_id for r in ve.near_hits(asked, cached(far), 0.25).collect()] == ["0"]
    assert ve.near_hits(asked, cached(far, near), 0.25).collect() == []


def test_numbering_equals_the_plain_window(spark):
    rows = spark.createDataFrame([(k, s, o) for k in range(3) for s in range(4) for o in range(5)], "k int, s int, o int")
    got = numbered(rows, ["k"], "s", ["o"], "n").collect()
    assert all(r.n == r.s * 5 + r.o + 1 for r in got) and len(got) == 60


def test_replayed_ingest_changes_nothing(spark, tmp_path):
    items = [
        {"id": "1", "name": "Reds vs Blues", "matchType": "t20", "status": "Reds won", "dateTimeGMT": "2024-03-01T10:00:00", "teams": ["Reds", "Blues"], "matchStarted": True, "matchEnded": True},
        {"id": "2", "name": "Old", "dateTimeGMT": "2024-02-01T10:00:00", "matchStarted": True, "matchEnded": True},
        {"id": "3", "name": "Live", "dateTimeGMT": "2024-03-01T10:00:00", "matchStarted": True},
        {"id": "4", "name": "Bad date", "date": "soon", "matchStarted": True, "matchEnded": True},
        {"id": "5", "name": "Known", "dateTimeGMT": "2024-03-01T09:00:00", "matchStarted": True, "matchEnded": True},
    ]
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(i) for i in items))
    archived = spark.createDataFrame([("5",)], "match_id string")

    def run():
        from wicketlake.schemas import FEED_ITEM_DDL

        stream = fd.normalize_feed(spark.readStream.schema(FEED_ITEM_DDL).json(str(source)))
        told = lambda d: d.withColumns({"winner": F.lit("Reds"), "top_batters": F.lit(""), "top_bowlers": F.lit("")}).withColumn("narrative", fd.narrative())
        reference = F.lit("2024-03-01 20:00:00").cast("timestamp")
        lv.start_ingest(stream, root, told, archived, reference).awaitTermination()
        return sorted(r.id for r in lv.ingested_docs(spark, root).collect())

    assert run() == ["match:1"]
    (source / "b.json").write_text("\n".join(json.dumps(i) for i in items[:1] + [{**items[0], "id": "6"}]))
    assert run() == ["match:1", "match:6"]
    assert run() == ["match:1", "match:6"]
    assert run_counts(spark, root) == [(2, 1, 1, 0), (1, 1, 0, 0)]  # the repeat within the lookback is not seen again


def run_counts(spark, root):
    return [(r.completed, r.ingested, r.skipped, r.failed) for r in lv.ingest_runs(spark, root).orderBy("batch_id").collect()]


def feed_item(id_, status="done", hour=10):
    return {"id": id_, "name": f"Match {id_}", "matchType": "t20", "status": status, "dateTimeGMT": f"2024-03-01T{hour}:00:00", "teams": ["Reds", "Blues"], "matchStarted": True, "matchEnded": True}


def test_ingest_of_several_batches(spark, tmp_path):
    """A repeat in a later batch, a broken item and untouched parts of the store."""
    from wicketlake.schemas import FEED_ITEM_DDL

    batches = [[feed_item(str(i)) for i in range(6)], [feed_item("3"), feed_item("7", "broken"), feed_item("8")], [feed_item("9", hour=11)]]
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    told = lambda d: d.withColumns({"winner": F.lit("Reds"), "top_batters": F.lit(""), "top_bowlers": F.lit("")}).withColumn(
        "narrative", F.when(F.col("status") != "broken", fd.narrative())
    )
    reference = F.lit("2024-03-01 20:00:00").cast("timestamp")
    for n, items in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(json.dumps(i) for i in items))
        stream = fd.normalize_feed(spark.readStream.schema(FEED_ITEM_DDL).json(str(source)))
        lv.start_ingest(stream, root, told, None, reference).awaitTermination()
    wanted = {f"match:{i}" for i in (0, 1, 2, 3, 4, 5, 8, 9)}
    assert sorted(r.id for r in lv.ingested_docs(spark, root).collect()) == sorted(wanted)
    assert run_counts(spark, root) == [(6, 6, 0, 0), (2, 1, 0, 1), (1, 1, 0, 0)]
    # the last batch wrote one part only; the others are as earlier batches left them
    latest = max(store.current_parts(spark, root).values())
    assert list(store.current_parts(spark, root).values()).count(latest) == 1 and store.read_store(spark, root, before=latest).count() == 7


def test_store_replaces_and_replays(spark, tmp_path):
    root = str(tmp_path)
    docs = lambda rows: spark.createDataFrame([(i, "t", d, {"k": d}) for i, d in rows], "id string, doc_type string, document string, metadata map<string,string>")
    store.merge(docs([(str(i), "old") for i in range(40)]), root, 0, parts=8)
    for _ in range(2):  # a repeated batch replaces itself
        store.merge(docs([("3", "new"), ("99", "new")]), root, 1, parts=8)
        got = {r.id: r.document for r in store.read_store(spark, root).collect()}
        assert got == {**{str(i): "old" for i in range(40)}, "3": "new", "99": "new"}
    assert store.read_store(spark, root, before=1).count() == 40 and store.read_store(spark, str(tmp_path / "none")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from wicketlake.plans import ENTRIES

    sf = "/root/testdata/sf0.001"
    for key in ("fuzzy_search", "cache_similar_documents", "entity_mentions", "knowledge_lookup", "head_to_head_all"):
        plan = plan_of(ENTRIES[key].build(spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
    board = plan_of(ENTRIES["leaderboard_runs"].build(spark, sf))
    assert "TakeOrderedAndProject" in board
    assert "SortMergeJoin" in plan_of(ENTRIES["player_batting"].build(spark, sf))
    page = plan_of(ENTRIES["docs_where_page"].build(spark, sf))
    assert "EqualTo(lang,en)" in page
    assert "SortAggregate" not in plan_of(ENTRIES["player_batting"].build(spark, sf))


def test_boxes_and_titles_have_no_cap(spark):
    from wicketlake.functions import wiki

    lines = "".join(f"| field_{i} = value {i} {'x' * 60}\n" for i in range(120))
    titles = "".join(f"| title{i} = Cup {i}\n| title{i}wins = {i}\n" for i in range(1, 7))
    pages = spark.createDataFrame([("t", "{{Infobox cricket team\n" + lines + titles)], "title string, wikitext string")
    fields = wiki.infobox_fields(pages)
    assert fields.count() == 132
    assert wiki.title_totals(fields).first()["major_titles"] == 21


def test_total_counts_all_hits(spark):
    from wicketlake.operators import search as se

    names = spark.createDataFrame([(f"n{i}", f"anna {chr(97 + i)}") for i in range(12)], "entity string, alias string")
    queries = spark.createDataFrame([(1, "anna")], "query_id int, text string")
    rows = se.search_page(queries, names, 1, 5).collect()
    assert len(rows) == 5 and {r["total"] for r in rows} == {12}
