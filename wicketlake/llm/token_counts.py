"""Token counts by a byte-level BPE vocabulary: merging by rank on ragged arrays."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketlake.llm.common import per_worker, text_groups, with_computed

# Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters and numbers that the vocabulary library's Unicode tables (16.0) do not have yet and
# the regex library's have; the vocabulary library takes them as other signs.
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)

NO_RANK = np.iinfo(np.int64).max


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare name is one of the public tokenizers, looked up where the task runs."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: itself if printable, else the next from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class ByteBpe:
    """Merge table as arrays sorted by pair, and a bounded memory of pre-tokens already counted."""

    def __init__(self, path: str, remembered: int = 200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError(f"{path}: only plain byte-level BPE vocabularies are supported")
        vocab = model["vocab"]
        self.width = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[x] for x in byte_letters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        order = np.argsort(left * self.width + right, kind="stable")
        self.pairs = (left * self.width + right)[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take white space or whole words are not supported")
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.pattern = regex.compile(PRE_TOKENS)
        self.newer = regex.compile(f"[{NEWER}]")
        older = PRE_TOKENS.replace(r"[^\s\p{L}\p{N}]", "@").replace(r"\p{L}", rf"[\p{{L}}--[{NEWER}]]")
        older = older.replace(r"\p{N}", rf"[\p{{N}}--[{NEWER}]]").replace("@", rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]")
        self.older = regex.compile(older, regex.V1)
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each byte string when no pair can be merged any more.

        All strings are one ragged array. In each round every string merges its own lowest-ranked pair, at
        all its places from left to right; strings without such a pair leave the array.
        """
        out = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), out)
        while len(symbols) > 1:
            keys = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            ranked = (self.pairs[at] == keys) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(ranked, self.ranks[at], NO_RANK), NO_RANK)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(first, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), sizes)
            going = lowest != NO_RANK
            merge = np.flatnonzero(going & (rank == lowest))
            # of places that overlap (a run of one symbol) every second one merges
            run = np.append(True, np.diff(merge) != 1)
            offset = np.arange(len(merge))
            merge = merge[(offset - np.maximum.accumulate(np.where(run, offset, 0))) % 2 == 0]
            symbols[merge] = self.merged[at[merge]]
            going[merge + 1] = False
            out -= np.bincount(owner[merge], minlength=len(out))
            symbols, owner = symbols[going], owner[going]
        return out

    def count(self, texts: list[str]) -> list[int]:
        totals, split = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            totals.append(len(parts) - 1)
            words: list[str] = []
            for part in parts:
                newer = not part.isascii() and self.newer.search(part)
                words += (self.older if newer else self.pattern).findall(part)
            split.append(words)
        known = self.known
        fresh = list(set().union(*split).difference(known))
        if fresh:
            if len(known) + len(fresh) > self.remembered:
                known.clear()
                fresh = list(set().union(*split))
            known.update(zip(fresh, self.lengths([w.encode() for w in fresh]).tolist()))
        totals = [n + sum(map(known.__getitem__, words)) for n, words in zip(totals, split)]
        for word in fresh:
            if len(word) > 64:
                del known[word]
        return totals


def token_counts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 1024,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    Counts what the vocabulary's own library gives without added special tokens; special strings inside a
    text are one token each. A null text counts as empty (0 bytes, 0 tokens); every row gives one row,
    repeated rows repeat; input columns with the names of the three new ones are replaced. Each text is
    counted whole in its own task; nothing is shuffled.
    """

    def start():
        bpe = per_worker(f"ranks {vocabulary}", lambda: ByteBpe(vocabulary_path(vocabulary)))

        def step(texts):
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens: list[int] = []
            for _, group in text_groups(texts):
                n_tokens += bpe.count(group)
            counts = pa.array(n_tokens, pa.int64())
            return [n_bytes, counts, pc.greater(counts, limit)]

        return step

    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
    return with_computed(docs, [text], fields, start, keep)


def token_totals(counted: DataFrame, by: str) -> DataFrame:
    """Documents, bytes and tokens for each value of ``by``, summed before the shuffle."""
    return counted.groupBy(by).agg(
        F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")
    )
