"""License scans: exact phrases, and short notices found with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketlake.llm.common import per_worker, text_groups, with_computed

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

NOTICES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", "either version 3 of the license or at your option any later version"),
    ("gpl", "released under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "licensed under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "this work is licensed under cc by 4 0"),
)

# Letters a-z stay, A-Z become small, other ASCII signs than digits separate words; bytes over 127 are word letters.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int


class Scanner:
    """Pieces of the notices in one automaton; a notice with k edits allowed has k + 1 pieces, so at least one
    piece stands unchanged in any text that is within k edits of it."""

    def __init__(self, phrases: Mapping[str, str], notices: Sequence[tuple[str, str]], share: float):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [Notice(label, text, max(1, int(len(text) * share))) for label, text in notices]
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.text)}){{e<={n.edits}}}(?= )") for n in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            cuts = np.linspace(0, len(n.text), n.edits + 2).astype(int)
            for begin, end in zip(cuts[:-1], cuts[1:]):
                seeds.setdefault(n.text[begin:end], []).append((i, int(begin)))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def places(self, line: bytes) -> list[tuple[int, str]]:
        """(word, label) of every place of a phrase in the words joined by spaces, with a space at either end."""
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = line.find(phrase, at + 1)
        found.sort()
        return [(line.count(b" ", 0, at), label) for at, label in found]

    def confirmed(self, i: int, line: str, low: int, high: int):
        """Matches of a notice that don't overlap: the best of a window, then those of the parts before and after it."""
        shortest, parts = len(self.notices[i].text) - self.notices[i].edits, [(low, high)]
        while parts:
            low, high = parts.pop()
            m = self.patterns[i].search(line, low, high) if high - low > shortest else None
            if m:
                yield m
                parts += [(low, m.start()), (m.end(), high)]

    def fuzzy(self, line: str) -> list[tuple[str, str, int, int, int]]:
        """(label, notice, first word, words, edits) of every place that the bounded-error search confirms."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(line):
            for i, offset in places:
                notice = self.notices[i]
                start = end + 1 - length - offset
                low, high = max(0, start - notice.edits - 1), start + len(notice.text) + notice.edits + 1
                known = windows.setdefault(i, [])
                if known and low <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], high)
                    known[-1][0] = min(known[-1][0], low)
                else:
                    known.append([low, high])
        found = []
        for i, spans in windows.items():
            for low, high in spans:
                for m in self.confirmed(i, line, max(0, low), min(len(line), high)):
                    word = line.count(" ", 0, m.start() + 1) - 1
                    found.append((self.notices[i].label, self.notices[i].text, word, m[0].count(" ") + 1, sum(m.fuzzy_counts)))
        return sorted(found, key=lambda x: (x[2], x[0], x[1]))


PLACE = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))
SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("notice", T.StringType()),
            T.StructField("word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("edits", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


def license_scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
    edit_share: float = 0.1,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_words, places and spans.

    places: every place where the words of a phrase stand one after another, overlapping ones too. spans:
    places of notices (phrases of words joined by spaces) with at most ``edit_share`` of their letters
    inserted, deleted or substituted, from word boundary to word boundary; score is 1 less edits by length.
    A null or empty text has no words and empty lists. Repeated rows repeat; input columns with the names
    of new ones are replaced. Texts are scanned whole in their own tasks; nothing is shuffled.
    """
    phrases, notices = dict(phrases), list(notices)
    key = f"notices {hash((tuple(phrases.items()), tuple(notices), edit_share))}"

    def start():
        scanner = per_worker(key, lambda: Scanner(phrases, notices, edit_share))
        lengths = {n.text: len(n.text) for n in scanner.notices}

        def step(texts):
            n_words, places, spans = [], [], []
            for _, group in text_groups(texts):
                for one in group:
                    words = one.encode().translate(WORD_BYTES).split()
                    line = b" %s " % b" ".join(words)
                    n_words.append(len(words))
                    places.append([{"word": w, "label": x} for w, x in scanner.places(line)])
                    spans.append(
                        [
                            dict(label=x, notice=n, word=w, n_words=k, edits=e, score=1 - e / lengths[n])
                            for x, n, w, k, e in scanner.fuzzy(line.decode())
                        ]
                    )
            return [
                pa.array(n_words, pa.int64()),
                pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                pa.array(
                    spans,
                    pa.list_(
                        pa.struct(
                            [
                                ("label", pa.string()),
                                ("notice", pa.string()),
                                ("word", pa.int64()),
                                ("n_words", pa.int64()),
                                ("edits", pa.int64()),
                                ("score", pa.float64()),
                            ]
                        )
                    ),
                ),
            ]

        return step

    fields = [T.StructField("n_words", T.LongType()), T.StructField("places", PLACE), T.StructField("spans", SPAN)]
    return with_computed(docs, [text], fields, start, keep)


def label_list(*arrays: Column) -> Column:
    """Distinct labels of all arrays, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
