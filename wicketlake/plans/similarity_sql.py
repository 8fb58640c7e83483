"""SQL of text similarity: edit distance with neighbour swaps, near words and the scores made of them."""

from __future__ import annotations


def osa(a: str, b: str) -> str:
    """Optimal string alignment distance by its recurrence, one row of the table a step.

    Where the distance with unrestricted swaps equals the one without swaps, so does this one, which lies between.
    """
    differs = f"CAST({a}[i] <> {b}[j] AS BIGINT)"
    swap = f"CASE WHEN i > 1 AND j > 1 AND {a}[i] = {b}[j - 1] AND {a}[i - 1] = {b}[j] THEN acc[1][j - 1] + {differs} ELSE 99999 END"
    cell = f"least(r[j] + 1, acc[2][j + 1] + 1, acc[2][j] + {differs}, {swap})"
    row = f"list_reduce(range(1, length({b}) + 1), lambda r, j: list_append(r, {cell}), [i])"
    rows = f"list_reduce(range(1, length({a}) + 1), lambda acc, i: [acc[2], {row}], [CAST([] AS BIGINT[]), range(0, length({b}) + 1)])"
    return (
        f"CASE WHEN {a} = '' THEN length({b}) WHEN {b} = '' THEN length({a}) "
        f"WHEN damerau_levenshtein({a}, {b}) = levenshtein({a}, {b}) THEN levenshtein({a}, {b}) ELSE {rows}[2][length({b}) + 1] END"
    )


def near(a: str, b: str, d: str) -> str:
    """Score of two words at edit distance ``d``."""
    longest = f"greatest(length({a}), length({b}))"
    ends = f"CASE WHEN left({a}, 1) = left({b}, 1) THEN 0.03 ELSE 0 END + CASE WHEN right({a}, 1) = right({b}, 1) THEN 0.02 ELSE 0 END"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN {longest} > 5 AND {d} <= 2 "
        f"THEN least(CASE WHEN {d} = 1 THEN 0.92 ELSE 0.87 END + {ends}, 0.97) WHEN {longest} > 3 AND {longest} <= 5 AND {d} = 1 THEN 0.84 ELSE 0.0 END"
    )


def similar(pairs: str) -> str:
    """Tables up to ``sim`` (q, a, similarity), for every distinct pair of normalised texts of ``pairs`` (q, a)."""
    return f"""
sim_pairs AS (SELECT DISTINCT q, a FROM ({pairs}) p WHERE q <> '' AND a <> ''),
sim_q AS (SELECT q, unnest(string_split(q, ' ')) AS w, generate_subscripts(string_split(q, ' '), 1) AS pos FROM (SELECT DISTINCT q FROM sim_pairs) t),
sim_a AS (SELECT DISTINCT a, unnest(string_split(a, ' ')) AS v FROM (SELECT DISTINCT a FROM sim_pairs) t),
sim_words AS (
  SELECT w, v, {near('w', 'v', 'd')} AS s FROM (
    SELECT w, v, {osa('w', 'v')} AS d FROM (SELECT DISTINCT w FROM sim_q) x, (SELECT DISTINCT v FROM sim_a) y WHERE abs(length(w) - length(v)) <= 2) z),
sim_typo AS (
  SELECT q, a, sum(best) / any_value(n) AS typo, CAST(sum(same) AS DOUBLE) / any_value(n) AS shared FROM (
    SELECT p.q, p.a, sim_q.pos, any_value(len(string_split(p.q, ' '))) AS n, max(CAST(s AS DOUBLE)) AS best, max(CAST(sim_q.w = sim_a.v AS INTEGER)) AS same
    FROM sim_pairs p JOIN sim_q ON sim_q.q = p.q JOIN sim_a ON sim_a.a = p.a JOIN sim_words ON sim_words.w = sim_q.w AND sim_words.v = sim_a.v
    GROUP BY p.q, p.a, sim_q.pos) t GROUP BY q, a),
sim_edits AS (SELECT q, a, {osa('q', 'a')} AS d, greatest(length(q), length(a)) AS n FROM sim_pairs),
sim AS (
  SELECT e.q, e.a, CASE WHEN e.q = e.a THEN 1.0 ELSE greatest(
    1 - CAST(d AS DOUBLE) / n, CASE WHEN n > 5 AND d <= 2 THEN CAST({near('e.q', 'e.a', 'd')} AS DOUBLE) ELSE 0 END,
    coalesce(typo, 0), coalesce(shared, 0), CASE WHEN contains(e.q, e.a) OR contains(e.a, e.q) THEN 0.9 ELSE 0 END,
    CASE WHEN contains(e.q, ' ') AND contains(e.a, ' ') AND string_split(e.q, ' ')[-1] = string_split(e.a, ' ')[-1]
      AND left(e.q, 1) = left(e.a, 1) THEN 0.92 ELSE 0 END) END AS similarity
  FROM sim_edits e LEFT JOIN sim_typo t ON t.q = e.q AND t.a = e.a)"""


def bonus(prefix: float = 0.45) -> str:
    return f"CASE WHEN a = q THEN 1.0 WHEN starts_with(a, q) THEN {prefix} WHEN contains(a, q) THEN 0.2 ELSE 0.0 END"


SEARCH_SCORE = (
    f"similarity + {bonus()} + CASE WHEN NOT contains(q, ' ') AND list_contains(string_split(a, ' '), q) THEN 0.3 ELSE 0.0 END "
    "+ CASE WHEN NOT contains(q, ' ') AND string_split(a, ' ')[-1] = q THEN 0.4 ELSE 0.0 END"
)


def searched(queries: str, aliases: str, least: float = 0.45) -> str:
    """Tables up to ``hits`` (q, entity, score), from ``queries`` (q) and ``aliases`` (entity, a), both normalised."""
    return (
        f"asked_q AS (SELECT DISTINCT q FROM ({queries}) t), alias_a AS (SELECT DISTINCT entity, a FROM ({aliases}) t), "
        + similar("SELECT q, a FROM asked_q, alias_a")
        + f", hits AS (SELECT q, entity, round(max(score), 6) AS score FROM (SELECT q, a, {SEARCH_SCORE} AS score FROM sim WHERE similarity >= {least} - 1e-12) s "
        f"JOIN alias_a USING (a) WHERE score >= {least} GROUP BY q, entity)"
    )
