"""Token counts by rank-synchronous merging of arrays.

All pre-tokens of a batch lie in one flat array of symbols with their lengths (ragged). In every
round each pre-token finds its lowest-ranked neighbouring pair, and all pre-tokens apply theirs at
the same time. A pre-token without a ranked pair is done; its surviving symbols are its tokens.

Merging all occurrences of a pair at once equals merging them from left to right one by one as
long as no pair with the new symbol ranks lower than the pair itself. Ranks for which that does
not hold merge their leftmost occurrence only, so counts are exact for any vocabulary.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import kept, with_text_column
from fathom.llm.pretokens import ALONE, REMEMBERED, Recent, per_text, split_units, values_of

LIMIT = 512
# Symbols merged together at a time; bounds the memory of a round.
ROUND_SYMBOLS = 4_000_000
_NONE = np.iinfo(np.int64).max


class RankTable:
    """Merge ranks of a byte-level vocabulary as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.specials = tuple(t["content"] for t in model["added_tokens"])
        self.width = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.product = np.array([vocab[a + b] for a, b in merges], np.int64)
        ranks = np.arange(len(merges))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], ranks[order]
        # The lowest rank of a pair that holds a symbol, and whether a product may precede its pair.
        lowest = np.full(self.width, _NONE)
        np.minimum.at(lowest, left, ranks)
        np.minimum.at(lowest, right, ranks)
        self.plain = lowest[self.product] > ranks
        letters = {ord(t): i for t, i in vocab.items() if len(t) == 1}
        self.letter = np.full(max(letters) + 1, -1, np.int64)
        for code, i in letters.items():
            self.letter[code] = i

    def ranks_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first * self.width + second
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE)


def merged_lengths(symbols: np.ndarray, lengths: np.ndarray, table: RankTable) -> np.ndarray:
    """Symbols left in each sequence after all merges; ``lengths`` are positive."""
    result = lengths.copy()
    who = np.arange(len(lengths))
    while len(symbols):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            rank[:-1] = table.ranks_of(symbols[:-1], symbols[1:])
        rank[ends - 1] = _NONE
        best = np.minimum.reduceat(rank, starts)
        open_ = best < _NONE
        result[who] = lengths
        if not open_.any():
            break
        inside = np.repeat(open_, lengths)
        symbols, rank = symbols[inside], rank[inside]
        lengths, best, who = lengths[open_], best[open_], who[open_]
        of = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(rank == best[of])
        # In a run of equal symbols every second occurrence overlaps the one before it.
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        run = np.flatnonzero(fresh)
        offset = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[offset % 2 == 0]
        first = np.ones(len(at), bool)
        first[1:] = of[at[1:]] != of[at[:-1]]
        at = at[first | table.plain[best[of[at]]]]
        symbols[at] = table.product[best[of[at]]]
        lengths = lengths - np.bincount(of[at], minlength=len(lengths))
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
    return result


class Counter:
    """Counts tokens of texts; remembers units and pre-tokens it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table = RankTable(path)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.units, self.pieces = Recent(), Recent(REMEMBERED // 2)

    def _piece_counts(self, pieces: list[str]) -> list[int]:
        counts: list[int] = []
        start, held = 0, 0
        for i, piece in enumerate(pieces):
            held += len(piece)
            if held >= ROUND_SYMBOLS or i + 1 == len(pieces):
                part = pieces[start : i + 1]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                counts.extend(merged_lengths(self.table.letter[codes], lengths, self.table).tolist())
                start, held = i + 1, 0
        return counts

    def _unit_counts(self, units: list[str]) -> list[int]:
        """Units with strings of special tokens are cut there; only a whole text can have some."""
        special = {
            i: n
            for i, u in enumerate(units)
            if u[0] == ALONE and (n := sum(u.count(t) for t in self.table.specials))
        }
        pieces = split_units(self.splitter, [ALONE if i in special else u for i, u in enumerate(units)])
        for i in special:
            alone = [units[i][1:]]
            for token in self.table.specials:
                alone = [p for text in alone for p in text.split(token)]
            pieces[i] = [p for ps in split_units(self.splitter, [ALONE + t for t in alone]) for p in ps]
        counts = list(map(sum, values_of(pieces, self.pieces, self._piece_counts)))
        for i, n in special.items():
            counts[i] += n
        return counts

    def __call__(self, texts: list[str]) -> list[int]:
        return [sum(v) for v in per_text(texts, self.table.specials, self.units, self._unit_counts)]


def counter(path: str) -> Counter:
    return kept(("counter", path), lambda: Counter(path))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; no shuffle.

    Counts are those of the vocabulary's own library without added begin or end tokens; strings of
    special tokens inside a text count as that token. Null and empty texts have 0 bytes and tokens.
    Repeated rows and null ids are kept as they are; columns besides doc_id and text are not read.
    ``tokenizer_path`` must exist on the executors.
    """
    counted = with_text_column(
        docs.select("doc_id", "text"), "n_tokens", "bigint", lambda: counter(tokenizer_path)
    )
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
