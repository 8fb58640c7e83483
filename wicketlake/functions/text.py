"""Text columns: cleaning, identity keys, rendering and extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character counted as whitespace when text is collapsed.
WHITESPACE = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)

# The runs of whitespace that are anything but one blank, so that blanks between words need no replacement.
NOT_ONE_BLANK = f"{WHITESPACE[:-1]}{{2,}}|{WHITESPACE[:-2]}&&[^ ]]"

# Words ignored in cached questions.
CACHE_STOP_WORDS = [
    "a", "an", "and", "are", "for", "how", "i", "in", "is", "me", "of", "please",
    "show", "tell", "the", "to", "what", "whats", "who",
]

# Synonyms folded in cached questions.
CACHE_SYNONYMS = {
    "high": "highest",
    "max": "highest",
    "maximum": "highest",
    "scores": "score",
}

# Encyclopedia fragments removed from answers (case-insensitive).
SCRUB_FRAGMENTS = [
    r"Australia,\s+officially\s+the[^\n.]{0,200}",
    r"Australia\s+is\s+a\s+country[^\n]*",
    r"Commonwealth\s+of\s+Australia[^\n]*",
    r"sixth-largest\s+country[^\n]*",
    r"\bland\s+area\b[^\n]*",
    r"mainland\s+of\s+the\s+Australian\s+continent[^\n]*",
    r"\bTasmania\b[^\n]{0,120}",
    r"megadiverse\s+country[^\n]*",
    r"country\s+in\s+Oceania[^\n]*",
    r"sovereign\s+country[^\n]*",
    r"Indian\s+Ocean[^\n]{0,80}",
]
# A word of each fragment, in lower case: a text without it has no such fragment.
SCRUB_WORDS = [
    "australia", "australia", "commonwealth", "sixth-largest", "area", "mainland", "tasmania", "megadiverse",
    "oceania", "sovereign", "indian",
]
SCRUB_REMAINS = r"\bcountry in oceania\b|\bsovereign country\b|\blocated in oceania\b"
SCRUB_MIN_TOKENS = 5

# Capitalised phrases that are headings, not names.
BLOCKED_PHRASES = [
    "Match Summary",
    "Recent Match",
    "Next Match",
    "Upcoming Matches",
]
PROPER_NAME = r"\b(?:[A-Z][a-z]+|[A-Z]{2,4})(?:\s+(?:[A-Z][a-z]+|[A-Z]{2,4})){1,4}\b"

# Start and end of an ASCII word.
_WORD_START = "(?<![0-9A-Za-z_])"
_WORD_END = "(?![0-9A-Za-z_])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound_once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def ascii_words(pattern: str) -> str:
    r"""``pattern`` with ``\b`` meaning an ASCII word edge, whatever the Java version.

    Every ``\\b`` of the patterns stands right before or right after a word: after a word
    character or a group, repeated or not, it ends one; otherwise it starts one.
    """
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    pieces = pattern[len(flags) :].split(r"\b")
    out = pieces[0]
    for piece in pieces[1:]:
        before = out.rstrip("*+?")
        space = before.endswith(("\\s", "."))
        ends = bool(before) and not space and (before[-1].isalnum() or before[-1] in "_)}]")
        out += (_WORD_END if ends else _WORD_START) + piece
    return flags + out


def matches(c, pattern: str) -> Column:
    return _col(c).rlike(ascii_words(pattern))


def find(c, pattern: str, group: int = 1) -> Column:
    """First match or the empty string."""
    return F.coalesce(F.regexp_extract(_col(c), ascii_words(pattern), group), F.lit(""))


def replace(c, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_col(c), ascii_words(pattern), by)


def strip(c) -> Column:
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"^\s+|\s+$", "")


def clean_text(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), WHITESPACE, " "))


def lenient_int(c) -> Column:
    """Integer, else the whole part of a decimal number, else 0."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.coalesce(
        text.try_cast("bigint"),
        text.try_cast("double").try_cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def table_int(c) -> Column:
    """``lenient_int`` for web tables: thousands separators, ``-`` for nothing."""
    return lenient_int(F.replace(F.trim(F.coalesce(_col(c), F.lit(""))), F.lit(","), F.lit("")))


def normalize_text(c) -> Column:
    """Lower case, dots dropped, anything but a-z, 0-9 as a single space."""
    lowered = F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), ".", "")
    return F.trim(F.regexp_replace(lowered, r"[^a-z0-9]+", " "))


def tokens(c) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def slugify(c) -> Column:
    return F.translate(normalize_text(c), " ", "-")


def to_number(c) -> Column:
    kept = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"[^0-9.-]", "")
    return F.coalesce(F.when(kept != "", kept.try_cast("double")), F.lit(0.0))


def first_non_empty(*cols) -> Column:
    return F.coalesce(*[F.nullif(F.trim(_col(c).cast("string")), F.lit("")) for c in cols], F.lit(""))


def hyphen_id(c) -> Column:
    """Lower case with runs of anything but letters and digits as one hyphen."""
    hyphened = F.regexp_replace(F.lower(clean_text(c)), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(hyphened, "^-+|-+$", "")


def stable_id(prefix: str, *parts) -> Column:
    """``prefix:slug-digest`` of the non-empty parts."""
    kept = F.array_join(F.filter(F.array(*[clean_text(p) for p in parts]), lambda p: p != ""), "|")
    raw = F.when(kept == "", F.lit(prefix)).otherwise(kept)
    slug = F.substring(hyphen_id(raw), 1, 48)
    return F.concat(
        F.lit(prefix + ":"),
        F.when(slug == "", F.lit(prefix)).otherwise(slug),
        F.lit("-"),
        F.substring(F.sha1(raw.cast("binary")), 1, 10),
    )


def cache_id(question) -> Column:
    folded = F.lower(clean_text(question))
    return F.concat(F.lit("semantic-cache-"), F.substring(F.sha1(folded.cast("binary")), 1, 24))


def cache_document(question) -> Column:
    """Bag of the meaningful words of a question, sorted, as one string."""
    lowered = F.lower(F.coalesce(_col(question), F.lit("")))
    words = F.split(F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " ")), " ")
    synonyms = F.create_map(*[F.lit(x) for pair in CACHE_SYNONYMS.items() for x in pair])
    folded = F.transform(words, lambda w: F.coalesce(F.try_element_at(synonyms, w), w))
    kept = F.filter(folded, lambda w: (F.length(w) > 1) & ~w.isin(CACHE_STOP_WORDS))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def preview(c, limit: int = 800) -> Column:
    text = F.coalesce(_col(c), F.lit(""))
    cut = F.concat(strip(F.substring(text, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def short_preview(c, limit: int = 500) -> Column:
    return F.substring(F.coalesce(_col(c), F.lit("")), 1, limit)


def unique_non_empty(values, limit: int | None = None) -> Column:
    """Trimmed, non-empty, first-seen order; at most ``limit`` when given."""
    kept = F.array_distinct(F.filter(F.transform(_col(values), strip), lambda v: v != ""))
    return F.slice(kept, 1, limit) if limit else kept


def token_overlap(left, right) -> Column:
    """Share of the distinct tokens of ``left`` that ``right`` has."""
    l, r = F.array_distinct(tokens(left)), F.array_distinct(tokens(right))
    return F.when((F.size(l) == 0) | (F.size(r) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(l, r)) / F.size(l)
    )


def pair_key(left, right) -> Column:
    l, r = F.coalesce(_col(left), F.lit("")), F.coalesce(_col(right), F.lit(""))
    return F.concat_ws("__", F.least(l, r), F.greatest(l, r))


def title_metric(c) -> Column:
    return F.initcap(F.trim(F.translate(F.coalesce(_col(c), F.lit("")), "_", " ")))


def stat_key(c) -> Column:
    lowered = F.regexp_replace(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9]+", "_")
    bare = F.regexp_replace(lowered, "^_+|_+$", "")
    return F.when(bare == "", F.lit("value")).otherwise(bare)


def scrub_text(c, fallback="") -> Column:
    """Drop encyclopedia fragments; text left too short gives ``fallback``.

    Each step is worked out once. A fragment is looked for only in a text that holds its word: what is dropped leaves a
    blank, so no word comes about by dropping.
    """

    def scrubbed(text: Column, lowered: Column) -> Column:
        out = text
        for fragment, word in zip(SCRUB_FRAGMENTS, SCRUB_WORDS, strict=True):
            out = bound_once(
                out, lambda o, f=fragment, w=word: F.when(F.contains(lowered, F.lit(w)), replace(o, "(?i)" + f, " ")).otherwise(o)
            )
        return F.trim(F.regexp_replace(out, NOT_ONE_BLANK, " "))

    def poor(out: Column, n: Column) -> Column:
        few = F.size(F.split(n, " ", SCRUB_MIN_TOKENS)) < SCRUB_MIN_TOKENS
        remains = (F.contains(n, F.lit("oceania")) | F.contains(n, F.lit("sovereign"))) & n.rlike(SCRUB_REMAINS)
        return (out == "") | out.rlike(r"^[^0-9A-Za-z_]") | few | remains

    def judged(out: Column) -> Column:
        return bound_once(normalize_text(out), lambda n: F.when(poor(out, n), F.lit(fallback)).otherwise(out))

    clean = bound_once(F.coalesce(_col(c), F.lit("")), lambda text: bound_once(F.lower(text), lambda low: scrubbed(text, low)))
    return bound_once(clean, judged)


def proper_names(c) -> Column:
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(ascii_words(PROPER_NAME)), F.lit(0))
    return F.array_distinct(F.filter(found, lambda v: ~v.isin(BLOCKED_PHRASES)))


def phrase_ngrams(c, min_words: int = 1, max_words: int = 4) -> Column:
    """Distinct word n-grams, longest first, left to right."""

    def all_grams(toks: Column) -> Column:
        def grams(size: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(toks) - (size - 1))
            return F.when(
                F.size(toks) >= size,
                F.transform(starts, lambda i: F.array_join(F.slice(toks, i, F.lit(size)), " ")),
            ).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(*[grams(size) for size in range(max_words, min_words - 1, -1)]))

    return bound_once(tokens(c), all_grams)


def relaxed_json(c, schema: str) -> Column:
    """Parse JSON; failing that, the text from the first ``{`` to the last ``}``."""
    text = F.trim(F.coalesce(_col(c), F.lit("")))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    readable = F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(inner).isNotNull(), inner)
    return F.from_json(readable, schema)


def lenient_flag(c, fallback: bool = False) -> Column:
    n = normalize_text(_col(c).cast("string"))
    return (
        F.when(n.isin("1", "true", "yes", "y"), True)
        .when(n.isin("0", "false", "no", "n"), False)
        .otherwise(fallback)
    )


def clamped_int(c, fallback: int, low: int, high: int) -> Column:
    number = _col(c).cast("string").try_cast("double")
    whole = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(number).cast("bigint")))
    return F.when(number.isNull() | F.isnan(number), F.lit(fallback)).otherwise(whole).cast("int")


def earliest_date(dates) -> Column:
    kept = F.filter(F.transform(_col(dates), lambda d: F.trim(d)), lambda d: d != "")
    return F.coalesce(F.array_min(kept), F.lit(""))


def date_iso(c) -> Column:
    """ISO date, in UTC, of a timestamp or date text; other text unchanged."""
    text = F.trim(F.coalesce(_col(c), F.lit("")))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return F.coalesce(F.date_format(utc, "yyyy-MM-dd"), text)


def sanitized_metadata(entries: dict) -> Column:
    """A string map of the non-null entries; nested values as JSON."""
    pairs = []
    for key, (value, nested) in entries.items():
        value = _col(value)
        pairs += [F.lit(key), F.to_json(value) if nested else value.cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
