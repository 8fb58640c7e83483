"""Encoding and decoding with a BPE model of the sentencepiece kind: a table of the last token of each prefix."""

from __future__ import annotations

import hashlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wicketlake.llm.common import per_worker, text_groups, with_computed
from wicketlake.llm.token_counts import vocabulary_path

SPACE = "▁"
NEVER = float("-inf")
NOTHING = np.iinfo(np.int64).min


class PieceBpe:
    """Pieces, scores and special ids come from the model file; encoding and decoding are done here.

    The encoding of any prefix of a text ends in one token only: the piece that matches there and is
    compatible with the last token of what stands before it. Two tokens are compatible if merging their
    joined string gives just the two; whole texts then split at the same places, because no merge can
    cross a place that it does not cross in the pair. The table of last tokens is filled from matches of
    an automaton, and the ids are read from it backwards.

    A token is the id of its piece; a character that is no piece is -1 - its code point.
    """

    def __init__(self, path: str, remembered: int = 60_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize
        self.end_id, self.unknown_id = model.eos_id(), model.unk_id()
        self.piece_ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.byte_values: dict[int, int] = {}
        self.scores = [0.0] * model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_values[i] = int(piece[3:5], 16)
                self.byte_ids[self.byte_values[i]] = i
            elif model.is_control(i):
                self.surface[i] = ""
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ "
            elif model.is_unused(i):
                raise ValueError(f"{path}: models with unused pieces are not supported")
            else:
                self.piece_ids[piece], self.scores[i] = i, model.get_score(i)
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.piece_ids))
        self.lengths = list(map(len, self.pieces))
        self.decimal = list(map(str, range(len(self.pieces))))
        # If no piece has a space after another character, no token crosses such a place.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.piece_ids)
        self.segments = regex.compile(".+" if inner else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", regex.DOTALL).findall
        self.histories: dict[int, tuple[bool, list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.listed: dict[str, str] = {}
        self.plain: dict[str, str] = {}
        self.remembered = remembered
        self.cut = SPACE if not inner and self.normalize("a").startswith(SPACE) else ""
        self.columns, self.slot_bits = 112, 19
        self.arrays()

    def history(self, token: int) -> tuple[bool, list, list]:
        """Merging of a token by itself (best score first, leftmost among equals): does it come out as one
        symbol; and, at each step, its last and first symbol with the score of the merge that comes next."""
        found = self.histories.get(token)
        if found is None:
            symbols = list(self.pieces[token]) if token >= 0 else [chr(-1 - token)]
            ends, starts, going = [], [], True
            while going:
                best, place = NEVER, -1
                for i in range(len(symbols) - 1):
                    j = self.piece_ids.get(symbols[i] + symbols[i + 1])
                    if j is not None and self.scores[j] > best:
                        best, place = self.scores[j], i
                ends.append((symbols[-1], best))
                starts.append((symbols[0], best))
                going = place >= 0
                if going:
                    symbols[place : place + 2] = [symbols[place] + symbols[place + 1]]
            found = self.histories[token] = len(symbols) == 1, ends, starts
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Does merging a and b together give just a and b? Both merge by themselves, in the order of their
        scores, unless at some step the symbols that meet make a piece whose merge would come first."""
        whole_a, ends, _ = self.history(a)
        whole_b, _, starts = self.history(b)
        if not (whole_a and whole_b):
            return False
        i = j = 0
        while True:
            (x, next_a), (y, next_b) = ends[i], starts[j]
            met = self.piece_ids.get(x + y)
            if met is not None and self.scores[met] > next_a and self.scores[met] >= next_b:
                return False
            if next_a == NEVER and next_b == NEVER:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def tokens(self, segment: str) -> list[int]:
        return self.extended("", [None], segment)

    def extended(self, before: str, last: list, segment: str) -> list[int]:
        """Tokens of ``segment``. ``last`` holds the table of ``before``; the part for the prefix that both
        share is kept, the rest is filled anew, so that sorted segments cost their new characters only."""
        shared, most = 0, min(len(before), len(segment))
        while shared < most and before[shared] == segment[shared]:
            shared += 1
        del last[shared + 1 :]
        last += [None] * (len(segment) - shared)
        pairs, width, filled = self.pairs, len(self.pieces), shared
        for end, (token, length) in self.automaton.iter(segment, max(0, shared + 1 - self.longest)):
            if end < shared:
                continue
            while filled < end:
                filled += 1
                if last[filled] is None:
                    last[filled] = -1 - ord(segment[filled - 1])
            end += 1
            if last[end] is not None:
                continue
            if end == length:
                if self.history(token)[0]:
                    last[end] = token
                continue
            key = last[end - length] * width + token
            fits = pairs.get(key)
            if fits is None:
                fits = pairs[key] = self.compatible(last[end - length], token)
            if fits:
                last[end] = token
        while filled < len(segment):
            filled += 1
            if last[filled] is None:
                last[filled] = -1 - ord(segment[filled - 1])
        out, end, lengths = [], len(segment), self.lengths
        while end:
            token = last[end]
            out.append(token)
            end -= lengths[token] if token >= 0 else 1
        out.reverse()
        return out

    def arrays(self) -> None:
        """The automaton as arrays, for many short segments at once: a row of next states for each state over
        the characters that pieces use most, the longest piece that ends in a state, and its next shorter one."""
        used = Counter(c for p in self.piece_ids for c in set(p))
        letters = [c for c, _ in sorted(used.items(), key=lambda x: (-x[1], x[0]))[: self.columns - 1]]
        # column 0: characters of no piece; self.columns: characters of pieces that have no column
        self.classes = np.zeros(0x110000, dtype=np.uint8)
        self.classes[[ord(c) for c in used]] = self.columns
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        children: list[dict[str, int]] = [{}]
        token, levels = [-1], [[0]]
        for piece, i in self.piece_ids.items():
            node = 0
            for depth, c in enumerate(piece, 1):
                step = children[node].get(c)
                if step is None:
                    step = children[node][c] = len(children)
                    children.append({})
                    token.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(step)
                node = step
            token[node] = i
        fail, ends = [0] * len(children), [-1] * len(children)
        self.after = np.zeros((len(children), self.columns), dtype=np.int32)
        for level in levels:
            for node in level:
                ends[node] = node if token[node] >= 0 else ends[fail[node]]
                for c, step in children[node].items():
                    back = fail[node]
                    while node and back and c not in children[back]:
                        back = fail[back]
                    fail[step] = children[back].get(c, 0) if node else 0
            nodes = np.array(level)
            if level != [0]:
                self.after[nodes] = self.after[np.array(fail)[nodes]]
            for node in level:
                for c, step in children[node].items():
                    column = self.classes[ord(c)]
                    if column < self.columns:
                        self.after[node, column] = step
        self.ending = np.array(ends, dtype=np.int32)
        self.shorter = np.array([ends[f] for f in fail], dtype=np.int32)
        self.token = np.array(token, dtype=np.int64)
        self.piece_lengths = np.array(self.lengths, dtype=np.int64)
        self.is_whole = np.full(len(self.pieces), -1, dtype=np.int8)
        self.slot_keys = np.full(1 << self.slot_bits, np.iinfo(np.int64).min, dtype=np.int64)
        self.slot_fits = np.zeros(1 << self.slot_bits, dtype=bool)

    def all_compatible(self, keys: np.ndarray) -> np.ndarray:
        """``compatible`` for packed pairs (last token * vocabulary size + next token), from a table of slots
        in which a new pair takes the place of an older one."""
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        fits, hit = self.slot_fits[slots], self.slot_keys[slots] == keys
        if not hit.all():
            missing = np.flatnonzero(~hit)
            fresh, place = np.unique(keys[missing], return_inverse=True)
            width = len(self.pieces)
            answers = np.array([self.compatible(k // width, k % width) for k in fresh.tolist()], dtype=bool)
            fits[missing] = answers[place]
            self.slot_keys[slots[missing]] = keys[missing]
            self.slot_fits[slots[missing]] = fits[missing]
        return fits

    def rows(self, segments: list[str]) -> list[list[int]]:
        """Tokens of segments sorted by length, all of characters that have a column or are in no piece: one table row each."""
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        begins, longest = np.cumsum(sizes) - sizes, int(sizes[-1])
        last = np.zeros((len(segments), longest + 1), dtype=np.int64)
        state = np.zeros(len(segments), dtype=np.int64)
        for end in range(1, longest + 1):
            rows = np.arange(np.searchsorted(sizes, end), len(segments))
            point = points[begins[rows] + end - 1]
            state[rows] = self.after[state[rows], self.classes[point]]
            last[rows, end] = -1 - point
            offered = self.ending[state[rows]]
            while True:
                some = offered >= 0
                rows, offered = rows[some], offered[some]
                if not len(rows):
                    break
                token = self.token[offered]
                begin = end - self.piece_lengths[token]
                fits = np.empty(len(rows), dtype=bool)
                at_start = begin == 0
                fits[at_start] = self.all_whole(token[at_start])
                inside = ~at_start
                fits[inside] = self.all_compatible(last[rows[inside], begin[inside]] * len(self.pieces) + token[inside])
                last[rows[fits], end] = token[fits]
                rows, offered = rows[~fits], self.shorter[offered[~fits]]
        found, rows, end = [], np.arange(len(segments)), sizes.copy()
        while len(rows):
            token = last[rows, end]
            column = np.full(len(segments), NOTHING, dtype=np.int64)
            column[rows] = token
            found.append(column)
            end = end - np.where(token >= 0, self.piece_lengths[np.maximum(token, 0)], 1)
            rows, end = rows[end > 0], end[end > 0]
        return np.stack(found[::-1], axis=1).tolist()

    def all_whole(self, tokens: np.ndarray) -> np.ndarray:
        for token in np.unique(tokens[self.is_whole[tokens] < 0]).tolist():
            self.is_whole[token] = self.history(token)[0]
        return self.is_whole[tokens] > 0

    def learn(self, segments: set[str]) -> None:
        """Put the codes of all segments into memory, which is emptied first where it would grow too large."""
        fresh = segments.difference(self.listed)
        if len(self.listed) + len(fresh) > self.remembered:
            self.listed.clear()
            self.plain.clear()
            fresh = segments
        if len(self.pairs) > self.remembered:
            self.pairs.clear()
        short, rest = [], []
        for segment in fresh:
            segment = self.cut + segment
            (short if len(segment) <= 32 else rest).append(segment)
        short.sort(key=len)
        if short:
            sizes = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
            points = np.frombuffer("".join(short).encode("utf-32-le"), dtype=np.uint32)
            covered = np.maximum.reduceat(self.classes[points], np.cumsum(sizes) - sizes) < self.columns
            rest += [s for s, c in zip(short, covered.tolist()) if not c]
            short = [s for s, c in zip(short, covered.tolist()) if c]
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            for segment, tokens in zip(part, self.rows(part)):
                while tokens[0] == NOTHING:
                    del tokens[0]
                self.keep(segment, tokens)
        before, last = "", [None]
        for segment in sorted(rest):
            self.keep(segment, self.extended(before, last, segment))
            before = segment

    def keep(self, segment: str, tokens: list[int]) -> None:
        ids = self.ids(tokens)
        segment = segment[len(self.cut) :]
        self.listed[segment] = " ".join([self.decimal[i] for i in ids])
        self.plain[segment] = "".join([self.surface[i] for i in ids]) if ids is tokens else self.spelled(ids)

    def forget(self, segments: set[str]) -> None:
        for segment in segments:
            if len(segment) > 64:
                self.listed.pop(segment, None)
                self.plain.pop(segment, None)

    def split(self, text: str) -> list[str]:
        """Segments of a normalized text that are encoded by themselves, without the space that all begin with."""
        if not self.cut:
            return self.segments(text)
        if SPACE * 2 not in text:
            return text[1:].split(SPACE) if text else []
        return [s[1:] for s in self.segments(text)]

    def ids(self, tokens: list[int]) -> list[int]:
        if min(tokens, default=0) >= 0:
            return tokens
        out: list[int] = []
        for token in tokens:
            if token >= 0:
                out.append(token)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(-1 - token).encode()]
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for s in self.split(self.normalize(text)) for i in self.ids(self.tokens(self.cut + s))]

    def spelled(self, ids: list[int]) -> str:
        """Text of ids without the treatment of the first space; runs of bytes are read as UTF-8."""
        out, held = [], bytearray()
        for i in ids:
            value = self.byte_values.get(i)
            if value is not None:
                held.append(value)
                continue
            if held:
                out.append(utf8(held))
                held = bytearray()
            out.append(self.surface[i])
        if held:
            out.append(utf8(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.spelled(ids)
        return text[1:] if text.startswith(" ") else text


def utf8(held: bytearray) -> str:
    """Bytes as text; each byte that is part of no character gives one replacement character."""
    text, rest = [], bytes(held)
    while rest:
        for n in (1, 2, 3, 4):
            try:
                text.append(rest[:n].decode())
                rest = rest[n:]
                break
            except UnicodeDecodeError:
                continue
        else:
            text.append("�")
            rest = rest[1:]
    return "".join(text)


def encode_and_decode(
    docs: DataFrame,
    model: str = "piece_bpe_32k.model",
    text: str = "text",
    keep: list[str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text.

    Ids are those of the sentencepiece library with an end id only; the decoded text is what its decode
    gives for them. A null text counts as empty (the end id alone). Every row gives one row, repeated rows
    repeat; input columns with the names of new ones are replaced. Texts are encoded whole in their own
    tasks; nothing is shuffled.
    """

    def start():
        codec = per_worker(f"pieces {model}", lambda: PieceBpe(vocabulary_path(model)))
        end, sha = str(codec.end_id), hashlib.sha256

        def step(texts):
            n_tokens, ids_sha, decoded_sha, ids, decoded = [], [], [], [], []
            for _, group in text_groups(texts):
                split = [codec.split(codec.normalize(one)) for one in group]
                segments = set().union(*split)
                codec.learn(segments)
                for one in split:
                    listed = " ".join([*map(codec.listed.__getitem__, one), end])
                    plain = "".join(map(codec.plain.__getitem__, one))
                    plain = plain[1:] if plain.startswith(" ") else plain
                    n_tokens.append(listed.count(" ") + 1)
                    ids_sha.append(sha(listed.encode()).hexdigest())
                    decoded_sha.append(sha(plain.encode()).hexdigest())
                    if with_ids:
                        ids.append(list(map(int, listed.split(" "))))
                        decoded.append(plain)
                codec.forget(segments)
            made = [pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            return made + ([pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else [])

        return step

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return with_computed(docs, [text], fields, start, keep)
