"""Delivery, feed and question tables derived from a TPC-H-like star schema.

The expressions are plain SQL accepted by Spark and by other engines, so that a check in
another engine can use the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a ball, over lineitem, orders, customer and the two teams' names.
DELIVERY_SQL = {
    "match_id": "CAST(l_orderkey AS STRING)",
    "source_folder": "''",
    "data_version": "''",
    "match_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "season": "CAST(extract(year FROM o_orderdate) AS STRING)",
    "match_type": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'T20'"
    " WHEN o_orderpriority = '3-MEDIUM' THEN 'ODI' ELSE 'Test' END",
    "gender": "''",
    "team_type": "''",
    "venue": "c_mktsegment",
    "city": "''",
    "inning": "1 + l_linenumber % 2",
    "batting_team": "CASE WHEN l_linenumber % 2 = 0 THEN team_a ELSE team_b END",
    "over": "0",
    "batter": "concat('Player ', CAST(l_partkey % 97 AS STRING))",
    "bowler": "concat('Player ', CAST((l_suppkey * 7 + l_linenumber) % 97 AS STRING))",
    "extras_wides": "CASE WHEN CAST(round(l_tax * 100) AS INT) = 8 THEN 1 ELSE 0 END",
    "extras_noballs": "CASE WHEN CAST(round(l_tax * 100) AS INT) = 7 THEN 1 ELSE 0 END",
    "extras_byes": "CASE WHEN CAST(round(l_discount * 100) AS INT) = 1 THEN 1 ELSE 0 END",
    "runs_batter": "CASE WHEN CAST(round(l_tax * 100) AS INT) = 8 THEN 0 ELSE CAST(l_quantity AS INT) % 7 END",
    "non_boundary": "CASE WHEN l_returnflag = 'R' AND CAST(l_quantity AS INT) % 2 = 0 THEN 1 ELSE 0 END",
    "wicket_count": "CASE WHEN l_linestatus = 'F' AND CAST(l_quantity AS INT) % 5 = 0 THEN 1 ELSE 0 END",
    "wicket_kind": "CASE WHEN NOT (l_linestatus = 'F' AND CAST(l_quantity AS INT) % 5 = 0) THEN ''"
    " WHEN l_partkey % 8 = 0 THEN 'bowled' WHEN l_partkey % 8 = 1 THEN 'caught'"
    " WHEN l_partkey % 8 = 2 THEN 'lbw' WHEN l_partkey % 8 = 3 THEN 'stumped'"
    " WHEN l_partkey % 8 = 4 THEN 'run out' WHEN l_partkey % 8 = 5 THEN 'hit wicket'"
    " WHEN l_partkey % 8 = 6 THEN 'caught and bowled' ELSE 'retired hurt' END",
    "match_winner": "CASE WHEN o_orderstatus = 'F' THEN team_a WHEN o_orderstatus = 'O' THEN team_b ELSE '' END",
    # One number, so that the smallest is found by hash aggregation.
    # Fits a long for up to 900 lines of an order; 372 and 31 keep the order of days.
    "row_seq": "CAST(l_linenumber AS BIGINT) * 10000000000000000 + CAST(extract(year FROM l_shipdate) * 372"
    " + extract(month FROM l_shipdate) * 31 + extract(day FROM l_shipdate) AS BIGINT) * 10000000000 + l_partkey",
}
# Columns that build on the ones above.
DERIVED_SQL = {
    "wicket_player_out": "CASE WHEN wicket_count = 1 THEN batter ELSE '' END",
    "runs_extras": "extras_wides + extras_noballs + extras_byes",
    "runs_total": "runs_batter + extras_wides + extras_noballs + extras_byes",
}
# Columns of a ball that its match alone decides.
MATCH_COLUMNS = ["match_date", "season", "match_type", "venue", "match_winner"]
TEAM_A_KEY = "l_orderkey % 25"
TEAM_B_KEY = "(l_orderkey + 1 + l_orderkey % 24) % 25"
#: Rows of the ball table that meet their matches in one task.
BALLS_IN_PART = 500_000

# Question texts with slots: some for each kind of question that the labels tell apart.
QUESTION_TEMPLATES = [
    "hey there",
    "thanks, that was quick",
    "sing me a song about the sea",
    "write code for a sorting game",
    "score of the {team} game right now",
    "is {team} playing live at the moment",
    "fixtures of {team} this week",
    "upcoming schedule for {Team} and {Team2}",
    "latest news on {Player}",
    "{player} career numbers",
    "give me the t20 record of {player}",
    "{Player} runs in {year}",
    "how did {Player} do in test cricket during {year}",
    "{player} strike rate against {team}",
    "recent form of {Player}",
    "did {player} retire",
    "injury update for {player}",
    "for which side does {player} bat now",
    "who exactly is {Player}",
    "profile of {player2} please",
    "{team} win percentage",
    "{Team} results in the {year} season",
    "summary of team {team2}",
    "how many trophies has {team} lifted",
    "home ground and coach of {team}",
    "full squad of {team}",
    "playing eleven of {Team} against {Team2}",
    "previous meeting of {team} and {team2}",
    "h2h between {team} and {team2}",
    "{Team} versus {Team2} in one day games",
    "put {player} next to {player2} and compare",
    "is {Player} better than {Player2}",
    "difference between {Player} and {Player2} in tests",
    "{player} or {player2}: who is the stronger finisher",
    "why is {team} so inconsistent away from home",
    "who will win when {team} face {team2}",
    "predict the winner of match {match}",
    "chances of rain at the {team} ground",
    "fantasy picks for {team} tonight",
    "leading run scorers of {year}",
    "players with most fours in odi",
    "who hit the most sixes for {team}",
    "lowest economy among bowlers in t20",
    "top wicket takers of the world cup",
    "quickest hundred in one day international games",
    "highest individual score in odi history",
    "fastest 100 in twenty20",
    "best bowling figures in one day international",
    "lowest total in a test match",
    "most wickets at any wc",
    "longest six on record",
    "icc ranking of {team}",
    "standings after match {match}",
    "scorecard of match no {match}",
    "explain the free hit",
    "define economy rate",
    "meaning of run rate",
    "what is a googly",
    "how does the drs review work",
    "what happens under duckworth lewis",
    "odi and test: what is the difference between them",
    "training drill for leg spin",
    "which bat should a beginner buy",
    "when was the first world cup held",
    "and what about his average",
    "how many wickets has he taken",
    "show her best score",
    "did they win more matches at home",
    "what is their record since {year}",
    "Average of {Player} For {Team} Since {year}",
    "South Africa stats",
    "New Zealand Versus West Indies",
]

# Names filled into the slots.
TEAM_SLOTS = [
    "india", "australia", "england", "pakistan", "new zealand", "south africa", "west indies",
    "sri lanka", "bangladesh", "afghanistan", "mumbai indians", "csk", "rcb", "kkr", "srh",
    "aus", "ind", "gt", "lsg", "united arab emirates",
]
PLAYER_SLOTS = [
    "arjun mehta", "tom hale", "s r iyer", "kofi", "van der berg", "lewis grant", "dilan perera",
    "imran sadiq", "ravi", "no such player", "ben stowe", "hamish tait",
]


def delivery_source_sql() -> str:
    """``SELECT`` of the whole delivery table as text, for engines with the raw tables as views."""
    columns = ", ".join(f'{sql} AS "{name}"' if name == "over" else f"{sql} AS {name}" for name, sql in DELIVERY_SQL.items())
    derived = ", ".join(f"{sql} AS {name}" for name, sql in DERIVED_SQL.items())
    return (
        f"SELECT b.*, {derived} FROM (SELECT {columns} FROM (SELECT l.*, o.*, c.*, a.n_name AS team_a, "
        "b.n_name AS team_b FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "JOIN customer c ON o.o_custkey = c.c_custkey "
        f"JOIN nation a ON a.n_nationkey = {TEAM_A_KEY} JOIN nation b ON b.n_nationkey = {TEAM_B_KEY}) s) b"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the files of ``df`` give fewer splits than there are cores.

    Small single-file inputs would otherwise run in one task. Large inputs are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def match_parts(balls: DataFrame) -> int:
    """How many parts a ball table is dealt out in: one for each ``BALLS_IN_PART`` rows, as counted from the footers
    of its files, and one for each core at least."""
    return max(balls.sparkSession.sparkContext.defaultParallelism, -(-balls.count() // BALLS_IN_PART))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery table. Nations are 25 rows by definition and are broadcast.

    Balls and matches meet by the id of the match in parts of bounded size, whatever the number of shuffle partitions.
    What follows by match stays in them, without another shuffle.
    """
    nation = table(spark, sf_dir, "nation")
    team_a = F.broadcast(nation.select(F.col("n_nationkey").alias("key_a"), F.col("n_name").alias("team_a")))
    team_b = F.broadcast(nation.select(F.col("n_nationkey").alias("key_b"), F.col("n_name").alias("team_b")))
    matches = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .drop("c_custkey")
    )
    balls = table(spark, sf_dir, "lineitem")
    parts = match_parts(balls)
    dealt = balls.withColumn("match_id", F.expr(DELIVERY_SQL["match_id"])).repartition(parts, "match_id")
    matches = matches.withColumn("match_key", F.col("o_orderkey").cast("string")).repartition(parts, "match_key")
    # What holds for a whole match is worked out before its balls meet it: its order's key is that of its lines.
    headed = (
        matches.withColumnRenamed("o_orderkey", "l_orderkey")
        .join(team_a, F.expr(f"{TEAM_A_KEY} = key_a"))
        .join(team_b, F.expr(f"{TEAM_B_KEY} = key_b"))
        .select("match_key", "team_a", "team_b", *[F.expr(DELIVERY_SQL[name]).alias(name) for name in MATCH_COLUMNS])
    )
    # Balls and matches both grow with the data: a sort-merge join, never a broadcast of either.
    joined = dealt.join(headed.hint("merge"), F.expr("match_id = match_key"))
    made = {"match_id", *MATCH_COLUMNS}
    base = joined.select(*[F.col(name) if name in made else F.expr(sql).alias(name) for name, sql in DELIVERY_SQL.items()])
    return base.withColumns({name: F.expr(sql) for name, sql in DERIVED_SQL.items()})


def _array(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _pick(values, index: str, dialect: str) -> str:
    if dialect == "spark":
        return f"element_at({_array(values)}, CAST(1 + ({index}) % {len(values)} AS INT))"
    return f"list_extract([{_array(values)[6:-1]}], CAST(1 + ({index}) % {len(values)} AS INT))"


def question_sql(dialect: str) -> dict:
    """Columns of the asked question of a conversation turn: a template with filled slots."""
    key = "(conv_id * 31 + turn * 7)"
    names = {
        "{team}": _pick(TEAM_SLOTS, "conv_id + turn", dialect),
        "{team2}": _pick(TEAM_SLOTS, "conv_id + turn + 1 + conv_id % 7", dialect),
        "{player}": _pick(PLAYER_SLOTS, "conv_id + turn * 5", dialect),
        "{player2}": _pick(PLAYER_SLOTS, "conv_id + turn * 5 + 1 + conv_id % 9", dialect),
        "{Team}": _pick([t.title() for t in TEAM_SLOTS], "conv_id + turn", dialect),
        "{Team2}": _pick([t.title() for t in TEAM_SLOTS], "conv_id + turn + 1 + conv_id % 7", dialect),
        "{Player}": _pick([t.title() for t in PLAYER_SLOTS], "conv_id + turn * 5", dialect),
        "{Player2}": _pick([t.title() for t in PLAYER_SLOTS], "conv_id + turn * 5 + 1 + conv_id % 9", dialect),
        "{year}": "CAST(1990 + (conv_id + turn) % 40 AS STRING)",
        "{match}": "CAST(10000 + conv_id AS STRING)",
    }
    text = _pick(QUESTION_TEMPLATES, key, dialect)
    for slot, value in names.items():
        text = f"replace({text}, '{slot}', {value})"
    return {
        "question_id": "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING), '-asked')",
        "conv_id": "conv_id",
        "turn": "turn",
        "text": text,
    }


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn, once as written and once as a cricket question made from its keys."""
    turns = spread(table(spark, sf_dir, "conversations"))
    asked = turns.select(*[F.expr(sql).alias(name) for name, sql in question_sql("spark").items()])
    written = turns.select(
        F.expr("concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING), '-written')").alias("question_id"),
        "conv_id",
        "turn",
        "text",
    )
    return asked.unionByName(written)


def question_source_sql() -> str:
    asked = ", ".join(f"{sql} AS {name}" for name, sql in question_sql("other").items())
    return (
        f"SELECT {asked} FROM conversations UNION ALL SELECT concat(CAST(conv_id AS STRING), '-', "
        "CAST(turn AS STRING), '-written') AS question_id, conv_id, turn, text FROM conversations"
    )
