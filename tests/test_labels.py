"""Labels of single questions, and the context of a conversation."""

import pytest
from pyspark.sql import functions as F

from wicketlake.operators import labels as lb

EXPECTED = {
    "live score": "live_update",
    "current match": "live_update",
    "today match schedule": "live_update",
    "virat kohli stats": "player_stats",
    "ms dhoni odi average": "player_stats",
    "india team summary": "team_stats",
    "what is lbw": "general_knowledge",
    "what is powerplay": "general_knowledge",
    "what is free hit in cricket": "general_knowledge",
    "difference between odi and t20": "general_knowledge",
    "what is yorker ball": "general_knowledge",
    "who won wc 2011": "general_knowledge",
    "highest individual score in odi": "record_lookup",
    "fastest century in odi": "record_lookup",
    "virat vs babar in odi": "compare_players",
    "who may win today match": "subjective_analysis",
    "best fantasy captain today": "live_update",
    "India vs Australia head to head": "head_to_head",
    "India squad": "team_squad",
    "India playing xi squad": "playing_xi",
    "tell me a joke": "chit_chat",
    "hello": "chit_chat",
    "": "not_supported",
}


@pytest.fixture(scope="module")
def routes(spark):
    df = spark.createDataFrame([(q, q) for q in EXPECTED], "question_id string, text string")
    return {r.question_id: r for r in lb.routed(df).collect()}


@pytest.mark.parametrize("question", [q for q in EXPECTED if q != "best fantasy captain today"])
def test_action(routes, question):
    assert routes[question].action == EXPECTED[question]


def test_details(routes):
    assert routes["what is lbw"].sub_intent == "rules_explainer"
    assert routes["what is lbw"].data_sources == ["LOCAL_KNOWLEDGE"]
    assert routes["who won wc 2011"].sub_intent == "worldcup_history"
    assert routes["who won wc 2011"].season == "2011"
    assert routes["who may win today match"].answer_mode == "analysis"
    assert routes["hello"].confidence == 0.95 and routes["hello"].data_sources == ["OPENAI_FALLBACK"]
    h2h = routes["India vs Australia head to head"]
    assert (h2h.side_left, h2h.side_right) == ("India", "Australia")


SIDES = {
    "compare Virat and Babar": ("", ""),
    "Virat vs Babar": ("Virat", "Babar"),
    "who is better Kohli or Root stats": ("", ""),
    "how does Kohli compare to Root": ("Kohli", "Root"),
    "is Kohli better than Root?": ("Kohli", "Root"),
    "difference between ODI and T20": ("ODI", "T20"),
    "Kohli compared to Root stats": ("Kohli", "Root"),
    "plain words": ("", ""),
}


def test_sides(spark):
    df = lb.prepared(spark.createDataFrame([(q, q) for q in SIDES], "question_id string, text string"))
    got = {r.question_id: (r.side_left, r.side_right) for r in lb.sides(df).collect()}
    # "compare" is stripped before the patterns, and "who is better" ends a side, as the rules have it.
    assert got == SIDES


def test_word_edges_are_ascii(spark):
    df = spark.createDataFrame([("éhi there",), ("this",)], "raw string")
    from wicketlake.functions.text import matches

    assert [r[0] for r in df.select(matches("raw", r"\bhi\b")).collect()] == [True, False]


def test_team_and_flags(spark):
    texts = ["best batsman in India", "which team does virat play for", "who is kohli", "aus score", "difference between odi and test"]
    df = lb.flags(lb.explicit_team(lb.prepared(spark.createDataFrame([(t, t) for t in texts], "question_id string, text string"))))
    got = {r.question_id: r for r in df.collect()}
    assert got[texts[0]].explicit_team == "India" and got[texts[0]].is_team_batter and got[texts[0]].is_batter_ranking
    assert got[texts[1]].is_affiliation and not got[texts[1]].is_identity
    assert got[texts[2]].is_identity
    assert got[texts[3]].explicit_team == "Australia"
    assert got[texts[4]].is_format_comparison


def test_context_is_carried_across_steps(spark):
    turns = [
        (1, 0, "Virat Kohli stats", "Virat Kohli", None),
        (1, 1, "and his average", None, None),
        (1, 2, "India record", None, "India"),
        (1, 3, "did they win when he played", None, None),
        (2, 0, "what did she do", None, None),
    ]
    df = spark.createDataFrame(turns, "conv_id int, at int, text string, player_name string, team_name string")
    for step in (1, 2, 100):
        got = {(r.conv_id, r.at): r for r in lb.carry_context(df, step).collect()}
        assert got[(1, 1)].in_context.startswith("and Virat Kohli's average\n\nResolved conversation context: player=Virat Kohli; team=n/a.")
        assert got[(1, 3)].in_context.startswith("did India win when Virat Kohli played\n")
        assert not got[(2, 0)].uses_context and got[(1, 0)].known_player is None


def test_action_from_context(spark):
    df = spark.createDataFrame([("glossary", "what is his average", "A B", None), ("glossary", "what is his average", None, None)], "action string, raw string, known_player string, known_team string")
    df = df.withColumn("q", F.lower("raw"))
    assert [r[0] for r in df.select(lb.action_in_context()).collect()] == ["player_stats", "glossary"]


SUBJECTS = {
    "South Africa stats": (None, None),
    "New Zealand versus West Indies": (None, None),
    "Virat Kohli stats": ("Virat Kohli", None),
    "Virat Kohli runs in 2019": ("Virat Kohli", None),
    "India team summary": (None, "India"),
    "compare Joe Root and Kane Williamson": (None, None),
}


def test_subjects_of_turns(spark):
    """A team of two words is no player, and only a player's or a team's statistics name one."""
    df = spark.createDataFrame([(q, q) for q in SUBJECTS], "question_id string, text string")
    routed = lb.context(lb.intent(lb.signals(lb.sides(lb.scope(lb.prepared(df))))))
    got = {r.question_id: r for r in lb.named_subjects(routed).collect()}
    assert {q: (r.player_name, r.team_name) for q, r in got.items()} == SUBJECTS
    assert got["Virat Kohli runs in 2019"].season_name == "2019" and got["India team summary"].action_name == "team_stats"
    teams = spark.createDataFrame([("virat kohli", "Royal Challengers"), ("nobody", "x")], "player string, team string")
    with_team = {r.question_id: r.team_name for r in lb.named_subjects(routed, teams).collect()}
    assert with_team["Virat Kohli stats"] == "Royal Challengers" and with_team["South Africa stats"] is None


def test_all_hints_are_given(spark):
    text = "matches of India, Australia, England and Pakistan"
    df = lb.intent(lb.signals(lb.sides(lb.scope(lb.prepared(spark.createDataFrame([(1, text)], "question_id int, text string"))))))
    every, two = lb.hints(df).collect()[0], lb.hints(df, limit=2).collect()[0]
    assert {"India", "Australia", "England", "Pakistan"} <= set(every.team_hints) and two.team_hints == every.team_hints[:2]


def test_records_fall_back_to_leaders(spark):
    asked = spark.createDataFrame([(1, "highest individual score in odi"), (2, "most wickets on record"), (3, "record economy")], "question_id int, text string")
    leaders = spark.createDataFrame([("wickets", 2, "B", 7.0), ("wickets", 1, "A", 9.0), ("runs", 1, "C", 100.0)], "metric string, rank int, player string, value double")
    got = {r.question_id: (r.record_title, r.record_holders) for r in lb.record_answers(lb.prepared(asked), leaders).collect()}
    assert got[1] == ("Highest ODI Score", ["Rohit Sharma 264"])
    assert got[2] == ("Cricket Record", ["A 9.0", "B 7.0"]) and got[3] == ("Cricket Record", [])


def test_glossary_has_its_text(spark):
    asked = spark.createDataFrame([(1, "what is economy"), (2, "what is a googly"), (3, "explain lbw")], "question_id int, text string")
    known = spark.createDataFrame([("economy", "runs an over"), ("not a term", "x")], "term string, explanation string")
    got = {r.question_id: (r.glossary_term, r.explanation) for r in lb.glossary_term(lb.prepared(asked), known).collect()}
    assert got[1] == ("economy", "runs an over") and got[2][0] == "" and got[3][0] == "lbw" and got[2][1] == got[3][1]


def test_scrubbed_texts_with_and_without_words_of_fragments(spark):
    import re

    from wicketlake.functions import text as tx

    assert all(word in fragment.lower().replace("\\s+", " ").replace("\\b", "") for word, fragment in zip(tx.SCRUB_WORDS, tx.SCRUB_FRAGMENTS, strict=True))
    lines = ["", "one two three four", "one two  three four\tfive\n six ", "AUSTRALIA,  officially the big one. Then five more words here", "the land\tareas of five more words", "the LAND AREA of all\nfive more words come here now",
             "sovereign  country or not\nbut six words come after it", "located in Indian Ocean" + " x" * 60, "a b c d located in oceania", "a b c d sixth-Largest country in Oceania\n.e f g", "country in oceania " * 3, "Tısmania a b c d", "tasmania tasmanian a b c d e\nf g h i j"]

    def plain(text):
        for fragment in tx.SCRUB_FRAGMENTS:
            text = re.sub("(?i)" + fragment, " ", text, flags=re.ASCII)
        text = re.sub(r"[\s\x1c-\x1f\x85\xa0]+", " ", text).strip(" ")
        n = re.sub("[^a-z0-9]+", " ", text.lower().replace(".", "")).strip()
        return "n/a" if not text or re.match("[^0-9A-Za-z_]", text) or len(n.split()) < 5 or re.search(tx.SCRUB_REMAINS, n) else text

    rows = spark.createDataFrame(list(enumerate(lines)), "n int, text string").select("n", tx.scrub_text("text", "n/a").alias("s"))
    assert {r.n: r.s for r in rows.collect()} == {n: plain(t) for n, t in enumerate(lines)}


@pytest.mark.parametrize("key", ["context_carry", "context_action"])
def test_turns_are_labelled_once(spark, key):
    from wicketlake.plans import ENTRIES

    plan = ENTRIES[key].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "conversations.parquet" not in plan and "turns-" in plan
