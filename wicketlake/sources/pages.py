"""Saved score pages: tables and text out of HTML, then match fields and scorecard lines."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.functions.text import bound_once, clean_text, find, first_non_empty, table_int

# Tags and classes that hold headings and score lines.
HEADING_TAGS = {"h1", "h2"}
HEADING_CLASSES = {"ds-text-title-lg", "ds-text-title-s", "ciPageTitle"}
TABLE_HEADING_TAGS = {"h2", "h3", "h4", "span", "strong"}
SCORE_CLASSES = {"ds-text-tight-m", "ds-text-tight-s", "ci-team-score", "ci-team-score-text"}
SILENT_TAGS = {"script", "style", "template"}
VOID_TAGS = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "col"}

PARTS_DDL = (
    "page_id bigint, url string, title string, headings array<string>, event_name string, event_start string, "
    "event_venue string, body string, "
    "score_texts array<string>, tables array<struct<heading: string, header: array<string>, rows: array<array<string>>>>"
)


class _Parts(HTMLParser):
    """Collects titles, headings, visible text, score texts and tables of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.title, self.headings = [], [], [], []
        self.json_ld, self.scores, self.tables, self.stack = [], [], [], []
        self.last_heading = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in VOID_TAGS:
            return
        classes = set((attrs.get("class") or "").split())
        sinks = []
        if tag == "title" and not self.title:
            sinks.append(self.title)
        if tag in HEADING_TAGS or classes & HEADING_CLASSES:
            self.headings.append([])
            sinks.append(self.headings[-1])
        if classes & SCORE_CLASSES:
            self.scores.append([])
            sinks.append(self.scores[-1])
        if tag == "script" and attrs.get("type") == "application/ld+json":
            self.json_ld.append([])
            sinks.append(self.json_ld[-1])
        if tag in TABLE_HEADING_TAGS:
            self.last_heading = []
            sinks.append(self.last_heading)
        if tag == "table":
            self.stack.append({"heading": self.last_heading, "rows": [], "head": False})
        elif self.stack:
            if tag == "thead":
                self.stack[-1]["head"] = True
            elif tag == "tr":
                self.stack[-1]["rows"].append([])
            elif tag in ("td", "th"):
                if not self.stack[-1]["rows"]:
                    self.stack[-1]["rows"].append([])
                cell = (tag, [])
                self.stack[-1]["rows"][-1].append(cell)
                sinks.append(cell[1])
        self.open.append((tag, sinks))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, _ = self.open.pop()
            if name == tag:
                break
        if tag == "table" and self.stack:
            self.tables.append(self.stack.pop())

    def handle_data(self, data):
        if not data.strip():
            return
        silent = any(t in SILENT_TAGS for t, _ in self.open)
        if not silent:
            self.text.append(data.strip())
        for tag, sinks in self.open:
            for sink in sinks:
                if not silent or tag == "script":
                    sink.append(data.strip())


EVENT_TYPES = ("SportsEvent", "Event")


def _event(blocks: list) -> dict:
    """The first sports event in the linked data of a page, single or in a list."""
    for block in blocks:
        try:
            data = json.loads(" ".join(block))
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if isinstance(item, dict) and item.get("@type") in EVENT_TYPES:
                return item
    return {}


def _page_parts(html: str) -> dict:
    parser = _Parts()
    parser.feed(html or "")
    parser.close()
    tables = []
    for t in parser.tables + parser.stack:
        rows = [[(kind, " ".join(text)) for kind, text in row] for row in t["rows"] if row]
        headed = bool(rows) and (t["head"] or all(kind == "th" for kind, _ in rows[0]))
        cells = [[text for _, text in row] for row in rows]
        tables.append(
            {
                "heading": " ".join(t["heading"]),
                "header": cells[0] if headed else [],
                "rows": cells[1:] if headed else cells,
            }
        )
    event = _event(parser.json_ld)
    place = event.get("location")
    return {
        "title": " ".join(parser.title),
        "headings": [" ".join(h) for h in parser.headings],
        "event_name": str(event.get("name") or ""),
        "event_start": str(event.get("startDate") or ""),
        "event_venue": str(place.get("name") or "") if isinstance(place, dict) else "",
        "body": "\n".join(parser.text),
        "score_texts": [" ".join(s) for s in parser.scores],
        "tables": tables,
    }


def page_parts(pages: DataFrame) -> DataFrame:
    """The pieces of each page (``page_id``, ``url``, ``html``) that the rest is taken from."""

    def parse(batches):
        for batch in batches:
            parts = pd.DataFrame([_page_parts(h) for h in batch["html"]], index=batch.index)
            yield pd.concat([batch[["page_id", "url"]], parts], axis=1)

    return pages.select("page_id", "url", "html").mapInPandas(parse, PARTS_DDL)


# How results, teams, scores and match types are written on a page.
STATUS_PATTERNS = {
    " won by ": r"(?i)([A-Za-z .&-]+ won by [^\n]+)",
    " beat ": r"(?i)([A-Za-z .&-]+ beat [^\n]+)",
    "match ": r"(?i)(Match (?:tied|drawn)[^\n]*)",
    "no result": r"(?i)(No result[^\n]*)",
}
TEAMS_PATTERN = r"(?i)([A-Za-z][A-Za-z .&-]+)\s+vs\s+([A-Za-z][A-Za-z .&-]+)"
VENUE_PATTERN = r"(?i)Venue\s*[:|-]\s*([^\n]+)"
PAGE_ID_PATTERN = r"/([0-9]{5,})(?:[/?#]|$)"
SCORE_PATTERN = r"([A-Za-z][A-Za-z .&-]+)\s+(\d+)(?:/(\d+))?(?:\s*\(([\d.]+)\))?"
MATCH_TYPES = ["Test", "ODI", "T20I", "T20", "IPL", "First-class", "List A"]
BOWLING_DDL = (
    "array<struct<name:string,overs:string,maidens:bigint,runs_conceded:bigint,wickets:bigint,noballs:bigint,"
    "wides:bigint,economy:double>>"
)


def match_meta(parts: DataFrame) -> DataFrame:
    """Match fields of each page from its title, headings, linked data, text and address."""
    versus = F.filter(F.transform("headings", lambda h: clean_text(h)), lambda h: F.contains(F.lower(h), F.lit(" vs ")))
    out = parts.withColumn("title", clean_text("title")).withColumn(
        "name", first_non_empty(F.try_element_at(versus, F.lit(1)), clean_text("title"), clean_text("event_name"))
    )
    # The pattern is tried only on text that holds its fixed words.
    lowered = F.lower("body")
    status = first_non_empty(
        *[F.when(F.contains(lowered, F.lit(words)), clean_text(find("body", p))) for words, p in STATUS_PATTERNS.items()]
    )
    out = out.withColumn("status", status)
    match_type = F.lit(None).cast("string")
    for kind in reversed(MATCH_TYPES):
        match_type = F.when(F.col("title").rlike(rf"(?i)\b{kind}\b"), kind).otherwise(match_type)
    start = clean_text("event_start")
    left, right = clean_text(find("name", TEAMS_PATTERN, 1)), clean_text(find("name", TEAMS_PATTERN, 2))
    return out.select(
        "page_id",
        first_non_empty(
            find("url", PAGE_ID_PATTERN),
            # a title alone gets a digest, so that long equal beginnings stay apart
            F.concat(
                F.substring(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}_]+", "-"), 1, 48),
                F.lit("-"),
                F.substring(F.sha2("name", 256), 1, 12),
            ),
        ).alias("match_id"),
        "name",
        F.filter(F.array(left, right), lambda t: t != "").alias("teams"),
        F.coalesce(match_type, F.lit("")).alias("match_type"),
        "status",
        first_non_empty(clean_text("event_venue"), clean_text(find("body", VENUE_PATTERN))).alias("venue"),
        start.alias("start_date"),
        F.when(F.col("status") == "", "").otherwise(
            clean_text(F.element_at(F.split("status", r"(?i)\bwon\b|\bbeat\b", 2), 1))
        ).alias("winner"),
        F.col("url").alias("source_url"),
        "score_texts",
        "tables",
    )


def score_lines(texts="score_texts") -> Column:
    """Distinct score lines of a page, in page order."""
    lines = F.transform(
        F.filter(texts, lambda t: t.rlike(SCORE_PATTERN)),
        lambda t: F.struct(
            clean_text(find(t, SCORE_PATTERN, 1)).alias("inning"),
            table_int(find(t, SCORE_PATTERN, 2)).alias("runs"),
            table_int(find(t, SCORE_PATTERN, 3)).alias("wickets"),
            clean_text(find(t, SCORE_PATTERN, 4)).alias("overs"),
        ),
    )
    return F.array_distinct(lines)


def _key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _decimal(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, ",", "").try_cast("double"), F.lit(0.0))


def _batting(table: Column) -> Column:
    def line(row: Column) -> Column:
        def cell(*names: str) -> Column:
            return _cell(table, row, *names)

        return F.struct(
            clean_text(cell("batter", "batting", "batsman")).alias("name"),
            clean_text(cell("out", "dismissal", "how_out")).alias("dismissal"),
            table_int(cell("r", "runs")).alias("runs"),
            table_int(cell("b", "balls")).alias("balls"),
            table_int(cell("4s", "fours")).alias("fours"),
            table_int(cell("6s", "sixes")).alias("sixes"),
            _decimal(cell("sr", "strike_rate")).alias("strike_rate"),
        )

    unnamed = ["extras", "total", "did not bat", "dnb"]
    return F.filter(F.transform(table.rows, line), lambda b: (b["name"] != "") & ~F.lower(b["name"]).isin(unnamed))


def _bowling(table: Column) -> Column:
    def line(row: Column) -> Column:
        def cell(*names: str) -> Column:
            return _cell(table, row, *names)

        return F.struct(
            clean_text(cell("bowler", "bowling")).alias("name"),
            clean_text(cell("o", "overs")).alias("overs"),
            table_int(cell("m", "maidens")).alias("maidens"),
            table_int(cell("r", "runs")).alias("runs_conceded"),
            table_int(cell("w", "wickets")).alias("wickets"),
            table_int(cell("nb", "no_balls")).alias("noballs"),
            table_int(cell("wd", "wides")).alias("wides"),
            _decimal(cell("eco", "economy")).alias("economy"),
        )

    return F.filter(
        F.transform(table.rows, line), lambda b: (b["name"] != "") & ~F.lower(b["name"]).isin("extras", "total")
    )


def _cell(table: Column, row: Column, *names: str) -> Column:
    """First non-empty cell of a row under one of the column names."""
    return first_non_empty(
        *[F.get(row, (F.array_position(table.header, F.lit(n)) - 1).cast("int")) for n in names]
    )


def innings_of(tables="tables", teams="teams") -> Column:
    """Innings of a page: each batting table with the bowling table that follows it."""

    def has(header: Column, *names: str) -> Column:
        return F.arrays_overlap(header, F.array(*[F.lit(n) for n in names]))

    keyed = F.transform(
        tables,
        lambda t: F.struct(
            clean_text(t.heading).alias("heading"),
            F.transform(t.header, lambda h: _key(h)).alias("header"),
            t.rows.alias("rows"),
        ),
    )

    def kind(t: Column) -> Column:
        batting = has(t.header, "r", "b") & has(t.header, "batter", "batting", "batsman")
        bowling = has(t.header, "bowler", "bowling") & has(t.header, "o", "overs") & has(t.header, "w", "wickets")
        return F.when(batting, "bat").when(bowling, "bowl")

    typed = F.transform(
        keyed,
        lambda t: F.struct(
            kind(t).alias("kind"), t.heading.alias("heading"),
            F.when(kind(t) == "bat", _batting(t)).alias("batting"),
            F.when(kind(t) == "bowl", _bowling(t)).alias("bowling"),
        ),
    )
    known = F.filter(typed, lambda t: (t.kind == "bowl") | ((t.kind == "bat") & (F.size(t.batting) > 0)))

    def paired(tables_in_order: Column) -> Column:
        joined = F.transform(
            tables_in_order,
            lambda t, i: F.struct(
                t.kind.alias("kind"), t.heading.alias("heading"), t.batting.alias("batting"),
                F.get(tables_in_order, i + 1).kind.alias("next_kind"),
                F.get(tables_in_order, i + 1).bowling.alias("bowling"),
            ),
        )
        return F.filter(joined, lambda t: (t.kind == "bat") & (F.coalesce(t.next_kind, F.lit("bowl")) == "bowl"))

    def finished(t: Column, i: Column) -> Column:
        bowling = F.coalesce(t.bowling, F.array().cast(BOWLING_DDL))
        numbered = F.when(t.heading == "", F.concat(F.lit("Innings "), (i + 1).cast("string"))).otherwise(t.heading)
        team = F.get(teams, F.pmod(i, F.greatest(F.size(teams), F.lit(1))))
        runs = F.aggregate(F.transform(t.batting, lambda b: b["runs"]), F.lit(0).cast("bigint"), lambda x, y: x + y)
        wickets = F.size(F.filter(t.batting, lambda b: ~F.lower(b.dismissal).isin("", "not out"))).cast("bigint")
        return F.struct(
            F.when(team.isNotNull() & ~F.contains(numbered, team), F.concat(team, F.lit(" Innings")))
            .otherwise(numbered)
            .alias("inning"),
            t.batting.alias("batting"),
            bowling.alias("bowling"),
            runs.alias("total_runs"),
            wickets.alias("total_wickets"),
            F.coalesce(F.get(bowling, F.lit(0)).overs, F.lit("")).alias("total_overs"),
        )

    return F.transform(bound_once(known, paired), finished)


def extract_scorecards(pages: DataFrame) -> DataFrame:
    """One record per page: match fields, score lines and innings. Rows never leave their task."""
    meta = match_meta(page_parts(pages))
    return meta.withColumns({"score": score_lines(), "scorecard": innings_of()}).drop("score_texts", "tables")


def raw_match_records(extracted: DataFrame) -> DataFrame:
    """Extracted pages as raw match records, for the match-file reader's schema."""
    return extracted.select(
        F.struct(
            F.col("match_id"), F.lit("1").alias("revision"), F.lit("web_scraper_v1").alias("data_version")
        ).alias("meta"),
        F.struct(
            "match_id",
            F.filter(F.array("start_date"), lambda d: d != "").alias("dates"),
            F.substring("start_date", 1, 4).alias("season"),
            "match_type",
            "venue",
            "teams",
            F.struct("winner").alias("outcome"),
        ).alias("info"),
    )
