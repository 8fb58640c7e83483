"""String similarity for fuzzy names, on batches of strings inside a task.

All inputs are normalised text (lower case letters, digits, single spaces).
"""

from __future__ import annotations

import numpy as np

# Scores of near-equal words.
NEAR_LONG_ONE_EDIT = 0.92
NEAR_LONG_TWO_EDITS = 0.87
NEAR_SAME_FIRST = 0.03
NEAR_SAME_LAST = 0.02
NEAR_CEILING = 0.97
NEAR_SHORT_ONE_EDIT = 0.84
SUBSTRING = 0.9
INITIAL_AND_LAST = 0.92

_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _codes(strings):
    """Letters as numbers from 1 (0 beyond the end), one row a string, and the lengths."""
    lengths = np.array([len(s) for s in strings], dtype=np.int32)
    width = int(lengths.max()) if len(lengths) else 0
    codes = np.zeros((len(strings), width), dtype=np.int32)
    for i, s in enumerate(strings):
        if s:
            codes[i, : len(s)] = np.frombuffer(s.encode("utf-32-le"), dtype=np.int32)
    return codes, lengths


def osa_distances(left, right):
    """Optimal string alignment distance of each pair: edits and swaps of neighbours, each part edited once.

    Distinct pairs are aligned once. The shorter text is the pattern: a column of the alignment is two bit
    vectors of one word for each letter of it, so that a letter of the other text costs a few operations for
    all pairs at once. Patterns of more than 64 letters take several words.
    """
    if len(left) == 0:
        return np.zeros(0, dtype=np.int32)
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    distinct = {pair: n for n, pair in enumerate(dict.fromkeys(ordered))}
    pairs, out = list(distinct), np.zeros(len(distinct), dtype=np.int32)
    by_words = {}
    for n, (a, _) in enumerate(pairs):
        by_words.setdefault(max(1, -(-len(a) // 64)), []).append(n)
    for words, group in by_words.items():
        for start in range(0, len(group), 1 << 16):
            part = group[start : start + (1 << 16)]
            out[part] = _aligned([pairs[n][0] for n in part], [pairs[n][1] for n in part], words)
    return out[[distinct[pair] for pair in ordered]]


def _shifted(v, carry_in):
    """``v`` moved up by one place over its words (first axis), with the lowest place from ``carry_in``."""
    moved = v << np.uint64(1)
    moved[1:] |= v[:-1] >> np.uint64(63)
    moved[0] |= np.uint64(carry_in)
    return moved


def _sum(a, b):
    """Sum of two numbers over their words, without the last carry."""
    total = a + b
    for w in range(1, len(a)):
        total[w] += _carried(a[w - 1], b[w - 1], total[w - 1])
    return total


def _carried(a, b, total):
    return ((a & b) | ((a | b) & ~total)) >> np.uint64(63)


def _aligned(patterns, texts, words):
    rows = {p: n for n, p in enumerate(dict.fromkeys(patterns))}
    row = np.array([rows[p] for p in patterns])
    a, la = _codes(list(rows))
    b, lb = _codes(texts)
    letters, code = np.unique(np.concatenate([[0], a.ravel(), b.ravel()]), return_inverse=True)
    a, b = code[1 : 1 + a.size].reshape(a.shape), code[1 + a.size :].reshape(b.shape)
    places = np.zeros((words, len(rows), len(letters)), dtype=np.uint64)  # where a pattern has a letter
    for i in range(a.shape[1]):
        inside = np.flatnonzero(la > i)
        places[i // 64, inside, a[inside, i]] |= np.uint64(1) << np.uint64(i % 64)
    la = la[row]
    last = np.zeros((words, len(row)), dtype=np.uint64)
    some = np.flatnonzero(la > 0)
    last[(la[some] - 1) // 64, some] = np.uint64(1) << ((la[some] - 1) % 64).astype(np.uint64)
    distance = la.astype(np.int32).copy()
    down, up = np.full_like(last, ~np.uint64(0)), np.zeros_like(last)
    diagonal, before = np.zeros_like(last), np.zeros_like(last)
    for j in range(b.shape[1]):
        here = places[:, row, b[:, j]]
        swapped = _shifted(~diagonal & here, 0) & before
        diagonal = (_sum(here & down, down) ^ down) | here | up | swapped
        right_up, right_down = up | ~(diagonal | down), diagonal & down
        inside = lb > j
        distance += (inside & ((right_up & last) != 0).any(axis=0)).astype(np.int32)
        distance -= (inside & ((right_down & last) != 0).any(axis=0)).astype(np.int32)
        right_up = _shifted(right_up, 1)
        down, up = _shifted(right_down, 0) | ~(diagonal | right_up), diagonal & right_up
        before = here
    return np.where(la == 0, lb, distance)


def near_word_scores(left, right):
    """Score of two words that may differ by a typing error; 0 when they differ by more."""
    left, right = list(left), list(right)
    lengths = np.array([max(len(a), len(b)) for a, b in zip(left, right)], dtype=np.int32)
    dist = osa_distances(left, right)
    first = np.array([bool(a) and bool(b) and a[0] == b[0] for a, b in zip(left, right)])
    last = np.array([bool(a) and bool(b) and a[-1] == b[-1] for a, b in zip(left, right)])
    empty = np.array([not a or not b for a, b in zip(left, right)])
    base = np.where(dist == 1, NEAR_LONG_ONE_EDIT, NEAR_LONG_TWO_EDITS)
    long_score = np.minimum(base + NEAR_SAME_FIRST * first + NEAR_SAME_LAST * last, NEAR_CEILING)
    score = np.where((lengths > 5) & (dist <= 2), long_score, 0.0)
    score = np.where((lengths > 3) & (lengths <= 5) & (dist == 1), NEAR_SHORT_ONE_EDIT, score)
    score = np.where(dist == 0, 1.0, score)
    return np.where(empty, 0.0, score)


def _near_words(left_words, right_words):
    """Scores above 0 between two vocabularies: {left word: {right word: score}}."""
    near = {}
    by_length = {}
    for w in right_words:
        by_length.setdefault(len(w), []).append(w)
    pairs_l, pairs_r = [], []
    for w in left_words:
        for length in range(max(1, len(w) - 2), len(w) + 3):
            for v in by_length.get(length, ()):
                if v == w:
                    near.setdefault(w, {})[v] = 1.0
                elif max(len(w), len(v)) > 3:
                    pairs_l.append(w)
                    pairs_r.append(v)
    if pairs_l:
        left_counts, right_counts = _counts(pairs_l), _counts(pairs_r)
        longest = np.array([max(len(a), len(b)) for a, b in zip(pairs_l, pairs_r)])
        close = np.nonzero(longest - np.minimum(left_counts, right_counts).sum(axis=1) <= 2)[0]
        pairs_l, pairs_r = [pairs_l[i] for i in close], [pairs_r[i] for i in close]
        for w, v, s in zip(pairs_l, pairs_r, near_word_scores(pairs_l, pairs_r)):
            if s > 0:
                near.setdefault(w, {})[v] = float(s)
    return near


def _counts(strings):
    """How often each letter occurs in each string."""
    out = np.zeros((len(strings), len(_ALPHABET) + 1), dtype=np.int32)
    for i, s in enumerate(strings):
        for ch in s:
            out[i, _ALPHABET.find(ch)] += 1
    return out


def similarity_scores(left, right, near=None, optimistic=False):
    """Similarity of each pair in [0, 1]: words shared, substring, edit distance, near words, initial and surname.

    ``optimistic`` puts the fewest edits the letters allow in place of the edit distance: an upper
    bound at a fraction of the cost.
    """
    left, right = list(left), list(right)
    if not left:
        return np.zeros(0)
    split = {s: s.split() for s in set(left) | set(right)}
    if near is None:
        near = _near_words({w for s in set(left) for w in split[s]}, {w for s in set(right) for w in split[s]})
    lengths = np.array([max(len(a), len(b)) for a, b in zip(left, right)], dtype=np.float64)
    if optimistic:
        dist = lengths - np.minimum(_counts(left), _counts(right)).sum(axis=1)
    else:
        dist = osa_distances(left, right).astype(np.float64)
    score = np.where(lengths > 0, 1 - dist / np.maximum(lengths, 1), 0.0)
    typing = np.nonzero((lengths > 5) & (dist <= 2))[0]
    if len(typing):
        words = near_word_scores([left[i] for i in typing], [right[i] for i in typing])
        score[typing] = np.maximum(score[typing], words)
    for i, (a, b) in enumerate(zip(left, right)):
        if not a or not b:
            score[i] = 0.0
            continue
        if a == b:
            score[i] = 1.0
            continue
        wa, wb = split[a], split[b]
        other = set(wb)
        shared = sum(w in other for w in wa) / len(wa)
        typo = sum(max((near.get(w, {}).get(v, 0.0) for v in other), default=0.0) for w in wa) / len(wa)
        best = max(float(score[i]), shared, typo, SUBSTRING if a in b or b in a else 0.0)
        if len(wa) >= 2 and len(wb) >= 2 and wa[-1] == wb[-1] and wa[0][0] == wb[0][0]:
            best = max(best, INITIAL_AND_LAST)
        score[i] = best
    return score


def edit_pairs(queries, names, least: float, cells: int = 1 << 22):
    """Index pairs of non-empty texts whose edit distance leaves at least the share ``least`` of the longer one."""
    pick_q, pick_n = [np.zeros(0, int)], [np.zeros(0, int)]
    if not queries or not names:
        return pick_q[0], pick_n[0]
    name_counts, name_lengths = _counts(names).astype(np.int16), np.array([len(s) for s in names], dtype=np.int32)
    query_counts = _counts(queries).astype(np.int16)
    held = 0
    waiting_q, waiting_n = [], []

    def align():
        qi, ni = np.concatenate(waiting_q), np.concatenate(waiting_n)
        longest = np.maximum([len(queries[i]) for i in qi], name_lengths[ni])
        near = 1 - osa_distances([queries[i] for i in qi], [names[i] for i in ni]) / longest >= least - 1e-12
        pick_q.append(qi[near])
        pick_n.append(ni[near])

    for qi, q in enumerate(queries):
        if not q:
            continue
        common = np.minimum(name_counts, query_counts[qi]).sum(axis=1)
        hits = np.flatnonzero((common >= least * np.maximum(name_lengths, len(q)) - 1e-9) & (name_lengths > 0))
        waiting_q.append(np.full(len(hits), qi))
        waiting_n.append(hits)
        held += len(hits)
        if held > cells // 16:
            align()
            waiting_q, waiting_n, held = [], [], 0
    if waiting_q:
        align()
    return np.concatenate(pick_q), np.concatenate(pick_n)
