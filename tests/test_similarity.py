"""Edit distance, similarity and candidate joins against plain definitions."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wicketlake.functions import similarity as sim
from wicketlake.operators import candidates as ca
from wicketlake.operators import search as se
from wicketlake.operators import vectors as ve

WORDS = st.text(alphabet="abcd ", max_size=9).map(lambda s: " ".join(s.split()))


def osa(a, b):
    """Optimal string alignment by its recurrence."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        cost = a[i - 1] != b[j - 1]
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + cost)
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + cost)
    return d[len(a), len(b)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=8))
def test_osa_matches_its_definition(pairs):
    got = sim.osa_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == [osa(a, b) for a, b in pairs]


def test_osa_examples():
    assert list(sim.osa_distances(["ab", "ca", "", "kitten"], ["ba", "abc", "xyz", "sitting"])) == [1, 3, 3, 3]


def typed(word):
    """A word with a typing error or two."""
    for _ in range(random.choice([0, 1, 1, 2])):
        i = random.randrange(len(word) + 1)
        word = random.choice([word[:i] + random.choice("abx") + word[i:], word[:i] + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]])
    return word


def odd_texts(seed, n):
    random.seed(seed)
    words = ["virat", "kohli", "rohit", "sharma", "singh", "ab", "de", "villiers", "williamson", "x", "steven", "abcdefghijklmnop"]
    texts = [" ".join(typed(random.choice(words)) for _ in range(random.randint(1, 4))) for _ in range(n)]
    return list(dict.fromkeys(" ".join(t.split()) for t in texts if t.split()))


@pytest.mark.parametrize("least", [0.3, 0.45, 0.6249, 0.72])
def test_no_similar_pair_is_lost(spark, least):
    queries, names = odd_texts(1, 60), odd_texts(2, 150) + ["a", "ohl", "virat kohli rohit sharma"]
    frame = lambda texts, name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    every = list(itertools.product(queries, names))
    full = sim.similarity_scores([q for q, _ in every], [a for _, a in every])
    wanted = {p: s for p, s in zip(every, full) if s >= least - 1e-12}
    got = {(r["q"], r["a"]): r["similarity"] for r in se.similar_names(frame(queries, "text"), frame(names, "alias"), least).collect()}
    assert set(got) == set(wanted) and all(abs(s - wanted[p]) < 1e-12 for p, s in got.items())
    # without edits only pairs are lost that are alike by edit distance of the whole alone
    near = {(r["q"], r["a"]) for r in ca.alike(frame(queries, "q"), frame(names, "a"), least, edits=False).collect()}
    assert near <= set(every) and all(1 - osa(q, a) / max(len(q), len(a)) >= least - 1e-9 for q, a in set(wanted) - near)


def test_candidates_are_few_among_many_names(spark):
    """Names of random words: hardly any pair shares a word, so hardly any pair may meet."""
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(5, 9)))
    names = [f"{word()} {word()}" for _ in range(20_000)]
    queries = [f"{typed(a.split()[0])} {a.split()[1]}" for a in names[:200]]
    frame = lambda texts, name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    met = ca.alike(frame(queries, "q"), frame(names, "a"), 0.45, edits=False).collect()
    assert {(q, a) for q, a in zip(queries, names)} <= {(r["q"], r["a"]) for r in met}
    assert len(met) <= 20 * len(queries)  # of 4,000,000 pairs


def test_edit_pairs_in_blocks(spark):
    texts = odd_texts(3, 80)
    frame = lambda name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    want = {(a, b) for a, b in itertools.product(texts, texts) if 1 - osa(a, b) / max(len(a), len(b)) >= 0.6}
    for block in (4096, 9):
        assert {tuple(r) for r in ca.edit_pairs(frame("q"), frame("a"), 0.6, block).collect()} == want


def test_similarity_tiers():
    pairs = [
        ("virat", "virat kohli", 1.0), ("v kohli", "virat kohli", 0.92), ("kohly", "kohli", 0.84),
        ("sachni", "sachin", 0.95), ("", "x", 0.0), ("rohit", "rohit", 1.0),
    ]
    got = sim.similarity_scores([a for a, _, _ in pairs], [b for _, b, _ in pairs])
    assert [round(float(s), 2) for s in got] == [w for _, _, w in pairs]


NAMES = ["Virat Kohli", "Rohit Sharma", "MS Dhoni", "Steve Smith", "Joe Root", "Kane Williamson", "Ravi Shastri"]


def aliases(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "entity string")
    return names.selectExpr("entity", "entity AS alias")


def test_equal_hits_go_by_strength(spark):
    """A bare surname names the stronger player, not the first by name."""
    names = spark.createDataFrame([("Anil Sharma", "Anil Sharma"), ("Rohit Sharma", "Rohit Sharma"), ("Zed Sharma", "Zed Sharma")], "entity string, alias string")
    strength = spark.createDataFrame([("Anil Sharma", 10, 900), ("Rohit Sharma", 9000, 200), ("Zed Sharma", 9000, 300)], "entity string, first long, second long")
    asked = spark.createDataFrame([(1, "sharma")], "query_id int, text string")
    order = lambda rows: [r.entity for r in sorted(rows, key=lambda r: r.place)]
    assert order(se.search_entities(asked, names, 3, strength=strength).collect()) == ["Zed Sharma", "Rohit Sharma", "Anil Sharma"]
    assert order(se.search_page(asked, names, 1, 3, strength).collect()) == ["Zed Sharma", "Rohit Sharma", "Anil Sharma"]
    assert se.resolve(asked, names, strength=strength).collect()[0].entity == "Zed Sharma"


def test_own_score_of_a_candidate(spark):
    asked = spark.createDataFrame([(1, "zzz", False)], "query_id int, text string, live_leaning boolean")
    candidates = spark.createDataFrame([("Virat Kohli", "Virat Kohli", "vector", False), ("Joe Root", "Joe Root", "x", False)], "entity string, alias string, source string, is_active boolean")
    own = spark.createDataFrame([(1, "Virat Kohli", 0.8), (1, "Joe Root", 0.3)], "query_id int, entity string, score double")
    got = {r.entity: r.weighted_score for r in se.weighted_entities(asked, candidates, own=own).collect()}
    assert got == {"Virat Kohli": 0.84, "Joe Root": 0.3}


def test_leaning_to_live_matches(spark):
    asked = spark.createDataFrame(
        [(1, "virat kohli", True), (2, "root", True), (3, "new boy", True), (4, "virat kohli", False), (5, "the king", True), (6, "qqqq", True)],
        "query_id int, text string, live_leaning boolean",
    )
    live = spark.createDataFrame([("Virat Kohli", True), ("New Boy", False)], "name string, is_active boolean")
    manual = spark.createDataFrame([("the king", "Virat Kohli")], "alias_norm string, canonical string")
    got = {r.query_id: r for r in se.resolve_leaning(asked, aliases(spark), live, manual=manual).collect()}
    assert (got[1].status, got[1].entity, got[1].branch) == ("resolved", "Virat Kohli", "archive")
    assert (got[1].score, got[4].score) == (2.63, 2.0)  # 1 + 1 + 0.18 + 0.45 live; plain: 1 + 1
    assert (got[2].status, got[2].entity, got[2].branch) == ("resolved", "Joe Root", "archive")
    assert (got[3].status, got[3].entity, got[3].branch) == ("resolved", "New Boy", "live")
    assert (got[4].branch, got[5].branch, got[5].entity) == ("plain", "plain", "Virat Kohli")
    assert (got[6].status, got[6].branch) == ("not_found", "plain")


def test_search_order_and_scores(spark):
    queries = spark.createDataFrame([(1, "kohli"), (2, "Rohit Shrama"), (3, "zzzz")], "query_id int, text string")
    rows = se.search_entities(queries, aliases(spark), 2).collect()
    best = {r.query_id: (r.entity, r.score) for r in rows if r.place == 1}
    # One shared word: similarity 1, contained 0.2, single word 0.3, last word 0.4.
    assert best[1] == ("Virat Kohli", 1.9)
    assert best[2][0] == "Rohit Sharma" and best[2][1] > 0.9
    assert 3 not in best


def test_resolution(spark):
    queries = spark.createDataFrame(
        [(1, "virat kohli"), (2, "the king"), (3, "qqqq"), (4, "show msd stats"), (5, "captain cool")], "query_id int, text string"
    )
    manual = spark.createDataFrame(
        [("the king", "Virat Kohli"), ("msd", "MS Dhoni"), ("captain cool", "Nobody Known")], "alias_norm string, canonical string"
    )
    got = {r.query_id: r for r in se.resolve(queries, aliases(spark), manual).collect()}
    assert (got[1].status, got[1].entity) == ("resolved", "Virat Kohli")
    assert (got[2].status, got[2].entity, got[2].score) == ("resolved", "Virat Kohli", 1.0)
    assert got[3].status == "not_found" and got[3].entity is None
    assert (got[4].status, got[4].entity) == ("resolved", "MS Dhoni")
    assert (got[5].status, got[5].entity) == ("resolved", "Nobody Known")


def test_live_leaning_asks_when_close(spark):
    weighted = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.85), (2, "a", 1.2), (2, "b", 0.5), (3, "c", 0.6)], "query_id int, entity string, weighted_score double")
    got = {r.query_id: r.status for r in se.resolve_live_leaning(weighted).collect()}
    assert got == {1: "clarify", 2: "resolved", 3: "clarify"}


def test_knowledge_scores(spark):
    knowledge = spark.createDataFrame(
        [("lbw", "rules_explainer", "LBW", ["lbw", "leg before wicket"], ["pad", "leg before"]), ("pp", "rules_explainer", "Powerplay", ["power play"], ["overs"])],
        "id string, sub_intent string, title string, aliases array<string>, keywords array<string>",
    )
    asked = spark.createDataFrame([(1, "what is lbw", "rules_explainer"), (2, "nonsense zzz", "")], "question_id int, text string, sub_intent string")
    rows = {(r.question_id, r.id): (r.score, r.place) for r in se.lookup_knowledge(asked, knowledge).collect()}
    # Contained alias 2.6, title similarity 0.9 - 0.35, topic 0.8.
    assert rows[(1, "lbw")] == (3.95, 1)
    assert not [k for k in rows if k[0] == 2]


def test_mentions(spark):
    texts = spark.createDataFrame([(i, f"Player {i} of NATION_{i}") for i in range(30)], "text_id int, text string")
    names = spark.createDataFrame([(f"NATION_{i}",) for i in range(30)] + [("nobody",), ("4",), ("of",), ("  ",), (None,)], "name string")
    a = sorted(map(tuple, se.entity_mentions(texts, names).collect()))
    known = [*(f"NATION_{j}" for j in range(30)), "4", "of"]
    brute = sorted((str(i), name) for i in range(30) for name in known if name in f"Player {i} of NATION_{i}")
    assert a == brute


def test_second_page(spark):
    queries = spark.createDataFrame([(1, "s")], "query_id int, text string")
    first = se.search_page(queries, aliases(spark), 1, 2).collect()
    second = se.search_page(queries, aliases(spark), 2, 2).collect()
    whole = [r.entity for r in sorted(se.search_entities(queries, aliases(spark), 4).collect(), key=lambda r: r.place)]
    assert [r.entity for r in sorted(first, key=lambda r: r.place)] == whole[:2]
    assert [r.entity for r in sorted(second, key=lambda r: r.place)] == whole[2:4]


def test_external_names(spark):
    queries = spark.createDataFrame([(1, "Virat Kohly"), (2, "zzzz")], "query_id int, text string")
    got = se.external_match(queries, aliases(spark)).collect()
    assert [(r.query_id, r.external_name, r.shown_name) for r in got] == [(1, "virat kohli", "virat kohli")]


def test_every_question_has_a_row(spark):
    knowledge = spark.createDataFrame([("lbw", "", "LBW", ["lbw"], ["pad"])], "id string, sub_intent string, title string, aliases array<string>, keywords array<string>")
    asked = spark.createDataFrame([(1, "what is lbw", ""), (2, "nonsense zzz", ""), (3, None, None)], "question_id int, text string, sub_intent string")
    got = {r.question_id: (r.id, r.found, r.score > 0) for r in se.lookup_knowledge(asked, knowledge, every=True).collect()}
    assert got == {1: ("lbw", True, True), 2: (None, False, False), 3: (None, False, False)}
    queries = spark.createDataFrame([(1, "Virat Kohly"), (2, "zzzz"), (3, None)], "query_id int, text string")
    got = {r.query_id: (r.external_name, r.shown_name, r.found) for r in se.external_match(queries, aliases(spark), every=True).collect()}
    assert got == {1: ("virat kohli", "virat kohli", True), 2: (None, "zzzz", False), 3: (None, "", False)}

def test_mentions_in_long_texts_and_of_short_names(spark):
    from wicketlake.operators import search as se

    letters = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    texts = [(n, letters[n:] + "é𝄞 XY" + letters[: 130 + n]) for n in range(70)] + [(98, "ab"), (99, "")]
    names = ["é𝄞", "X", "XY", "Y" + letters[:3], letters[60:70], letters[62:67], letters[126:131], letters[:64], letters[1:66], "zzzz", "ab", " "]
    t = spark.createDataFrame(texts, "text_id long, text string")
    k = spark.createDataFrame([(n,) for n in names], "name string")
    found = sorted(map(tuple, se.entity_mentions(t, k).collect()))
    assert found == sorted((str(i), n.strip()) for i, text in texts for n in names if n.strip() and n.strip() in text)


def test_mentions_make_no_index_of_all_runs(spark):
    """Only runs of names leave the pass over the texts: none of the others is shuffled."""
    from wicketlake.operators.candidates import containment

    texts = spark.range(3000).selectExpr("id", "concat(sha2(string(id), 512), ' Kofi ', id) AS text")
    names = spark.createDataFrame([("Kofi",)], "inner string")
    met = containment(names, texts, "text", "id")
    assert met.distinct().count() == 3000
    assert "Exchange hashpartitioning(run" not in met._jdf.queryExecution().executedPlan().toString()


def test_similar_questions_broadcast_no_table_that_grows(spark):
    """A written table of texts is small on disk only."""
    docs = spark.range(300).selectExpr("concat('predict winner match ', id) AS document")
    pairs = ve.similar_documents(docs, docs, 0.3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    # what meets by words and is made distinct are numbers; texts come after
    assert "HashAggregate(keys=[l_id" in plan
    assert pairs.count() == 300 * 300
    asked = spark.createDataFrame([(1, "who scored most runs in world cup final match"), (2, "who scored most runs in world cup final matc")], "question_id int, text string")
    cache = asked.filter("question_id = 1").selectExpr("'a' AS id", "text AS question_text", "'x' AS answer_text")
    hits = ve.near_hits(asked, cache, 0.3)
    assert "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {(r.question_id, r.cached_id) for r in hits.collect()} >= {(1, "a")}


def plan_records(plan):
    """Rows that the exchanges of an executed plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return plan_records(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return plan_records(plan.plan())
    if kind == "ReusedExchangeExec":
        return 0
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(plan_records(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("block", [4096, 50])
def test_pairs_of_short_questions_are_not_shuffled(spark, monkeypatch, block):
    """300 questions that differ in a number make 90,000 pairs, each of which went through two exchanges."""
    monkeypatch.setattr(ve, "WORD_BLOCK", block, raising=False)
    docs = spark.range(300).selectExpr("concat('predict winner match ', id) AS document")
    pairs = ve.similar_documents(docs, docs, 0.3)
    assert len(pairs.collect()) == 300 * 300
    assert plan_records(pairs._jdf.queryExecution().executedPlan()) < 50 * 300


@pytest.mark.parametrize("distance", [0.05, 0.3, 0.6])
def test_similar_bags_of_two_tables_and_of_frequent_words(spark, monkeypatch, distance):
    monkeypatch.setattr(ve, "WORD_BLOCK", 15)
    monkeypatch.setattr(ve, "SHORT_BAG", 6)
    random.seed(9)
    words = [f"w{i}" for i in range(60)] + ["common", "usual"] * 20
    drawn = [random.choices(words, k=random.randint(1, 40)) for _ in range(120)]
    drawn += [[*d[1:], "other"] for d in drawn[:60]]
    bags = sorted({" ".join(dict.fromkeys(d)) for d in drawn})
    random.shuffle(bags)
    left, right = bags[:110], bags[60:]
    far = lambda a, b: round(1 - len({*a.split()} & {*b.split()}) / math.sqrt(len({*a.split()}) * len({*b.split()})), 6)
    frame = lambda some: spark.createDataFrame([(b,) for b in some], "document string")
    same = frame(bags)
    for a, b, x, y in ((frame(left), frame(right), left, right), (same, same, bags, bags)):
        got = [tuple(r) for r in ve.similar_documents(a, b, distance).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(p, q, far(p, q)) for p in x for q in y if far(p, q) < distance}
