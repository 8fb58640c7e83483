"""Secret scans: rules are looked up in a trigram index before their patterns run."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _parser as syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import literal_rows, named


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern (leftmost, non-overlapping) whose group ``measured`` has ``least`` characters or more."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 0


# The base rules.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def literals(pattern) -> list[list[str]]:
    """The choices of a pattern as lists of strings that must stand in any match, in small letters."""
    choices: list[list[str]] = [[""]]

    def add(options: list[list[str]]) -> None:
        # the first string of an option continues the last string of what stands before it
        nonlocal choices
        choices = [[*a[:-1], a[-1] + o[0], *o[1:]] for a in choices for o in options]

    for op, value in pattern:
        name = str(op)
        if name == "LITERAL":
            add([[chr(value).lower()]])
        elif name == "SUBPATTERN":
            add(literals(value[3]))
        elif name == "BRANCH":
            add([o for part in value[1] for o in literals(part)])
        elif name == "IN" and all(str(x) == "LITERAL" for x, _ in value):
            add([[c] for c in sorted({chr(v).lower() for _, v in value})])
        elif name == "MAX_REPEAT" and value[:2] == (0, 1) and len(value[2]) == 1 and str(value[2][0][0]) == "LITERAL":
            add([[""], [chr(value[2][0][1]).lower()]])
        else:
            add([["", ""]])  # anything: the strings before and after it don't touch
    return choices


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams: any match has all trigrams of at least one set. No sets: nothing is mandatory."""
    choices = {
        frozenset(s[i : i + 3] for s in strings for i in range(len(s) - 2)) for strings in literals(syntax.parse(pattern))
    }
    if any(not c for c in choices):
        return []
    return sorted((c for c in choices if not any(d < c for d in choices)), key=sorted)


def trigram_postings(docs: DataFrame, trigrams: Sequence[str], doc_id: str, text: str) -> DataFrame:
    """(trigram, doc_id) for the trigrams that rules ask for, in small letters."""
    low = F.lower(named(text))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(named(doc_id).alias("doc_id"), F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], doc_id: str, text: str) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document meets, by intersecting postings."""
    queries = [(r.kind, n, t, len(q)) for r in rules for n, q in enumerate(trigram_query(r.pattern)) for t in sorted(q)]
    terms = literal_rows(docs.sparkSession, queries, "kind string, choice int, trigram string, needed int")
    postings = trigram_postings(docs, sorted({q[2] for q in queries}), doc_id, text)
    met = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "kind", "choice", "needed").agg(
        F.count_distinct("trigram").alias("found")
    )
    return met.where("found = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))




def spans_of(text: Column, rule: Rule) -> Column:
    """Matches of a rule as structs (start, kind, end), in code points, end exclusive.

    The pieces between matches and the matches themselves give the places: a match begins after the pieces
    and matches before it.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    measured = matches if not rule.measured else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.measured)), F.length)
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    step = F.aggregate(
        F.arrays_zip(pieces.alias("piece"), matches.alias("found"), measured.alias("size")),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda held, x: F.struct(
            (held["at"] + x["piece"] + F.coalesce(x["found"], F.lit(0))).alias("at"),
            F.when(
                x["size"] >= rule.least,
                F.concat(
                    held["spans"],
                    F.array(
                        F.struct(
                            (held["at"] + x["piece"]).alias("start"),
                            F.lit(rule.kind).alias("kind"),
                            (held["at"] + x["piece"] + x["found"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(held["spans"])
            .alias("spans"),
        ),
    )
    return step["spans"]


def scan_pattern(rule: Rule) -> Rule:
    """A rule of one repeated class can ask for its least length in the pattern itself: shorter runs never match."""
    if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and not rule.measured and rule.least > 1:
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule


def secret_scan(
    docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with spans: array of (start, kind, end) of all rules, ordered by start, then by the rules' order.

    A null text counts as empty and has no spans. Rows that share an id share the candidates of the index,
    and each is verified by itself; repeated rows repeat; a null id works like any other. An input column
    named spans is replaced. All steps are SQL functions.
    """
    rules = [scan_pattern(r) for r in rules]
    indexed = [r for r in rules if trigram_query(r.pattern)]
    kept = [c for c in docs.columns if c != "spans"]
    found = candidates(docs, indexed, doc_id, text).withColumnRenamed("doc_id", "_doc_id")
    out = docs.select(*[named(c) for c in kept]).join(found, named(doc_id).eqNullSafe(F.col("_doc_id")), "left")
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    whole = F.coalesce(named(text), F.lit(""))
    parts = []
    for rule in rules:
        if rule in indexed:
            asked = F.array_contains("kinds", rule.kind)
        else:
            asked = F.rlike(whole, F.lit(rule.pattern))
        parts.append(F.when(asked, spans_of(whole, rule)).otherwise(none))
    place = {r.kind: n for n, r in enumerate(rules)}
    ranks = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    by_place = F.transform(
        F.concat(*parts), lambda x: F.struct(x["start"].alias("start"), ranks[x["kind"]].alias("n"), x["kind"].alias("kind"), x["end"].alias("end"))
    )
    spans = F.transform(F.array_sort(by_place), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return out.select(*[named(c) for c in kept], spans.alias("spans"))


def listed(spans: Column) -> Column:
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def of_kind(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def masked(text: Column, spans: Column, sign: str = "[secret]") -> Column:
    """``text`` with each run of overlapping spans (ordered by start) replaced by ``sign``."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(held, x):
        # a span that begins before the end of what is already masked only extends it
        fresh = x["start"] + 1 >= held["at"]
        plain = F.substr(text, held["at"], F.greatest(x["start"] + 1 - held["at"], F.lit(0)))
        return F.struct(
            F.greatest(held["at"], x["end"] + 1).alias("at"),
            F.when(fresh, F.concat(held["out"], plain, F.lit(sign))).otherwise(held["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["at"])))
