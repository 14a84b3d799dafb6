"""Byte-level BPE encoding by replaying merges over a whole vocabulary of words, and decoding.

The pre-tokens of a group of texts are made distinct and laid out as one flat array of symbols
with links to their neighbours. An inverted index leads from a token pair, filed under the rank of
its merge, to all positions where the pair stands. Ranks are replayed in ascending order: each
merges all its positions, from left to right, and only the pairs with the two touched neighbours
are looked up again and filed. Words don't touch each other, so a group's words cost one replay,
however often they occur, and words seen before come from a bounded memory.

A merge may file a pair of a lower rank than its own (vocabularies whose longer token is older
than its part). The lower rank is then replayed first, and the word's remaining positions of the
present rank wait for their next turn, which is the order in which a word merges on its own.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import grouped_texts, kept, ship
from fathom.llm.pretokens import ALONE, REMEMBERED, Recent, gathered

# Bytes of distinct words replayed together; bounds the memory of an index.
REPLAY_BYTES = 500_000
# Pairs of tokens whose merge is remembered.
KNOWN_PAIRS = 500_000
# Letters of texts encoded together, and ids decoded together.
ENCODE_CHARS = 2_000_000
DECODE_IDS = 2_000_000
_NONE = -1


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        single = [bytes([b]) for b in range(256)]
        self.byte = np.array([self.ranks[b] for b in single], np.int64)
        self.byte_pairs = np.array([[self.ranks.get(a + b, _NONE) for b in single] for a in single], np.int64)
        self.known_pairs: dict[int, int] = {}

    def rank_of(self, pair: int) -> int:
        """Rank of the merge of two tokens (first << 32 | second), -1 where there is none."""
        rank = self.known_pairs.get(pair)
        if rank is None:
            if len(self.known_pairs) >= KNOWN_PAIRS:
                self.known_pairs.clear()
            rank = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], _NONE)
            self.known_pairs[pair] = rank
        return rank


def _first_index(flat: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> dict[int, list[int]]:
    """Positions of all pairs of neighbouring bytes that merge, by the rank of the merge."""
    ranks = np.full(len(flat), _NONE)
    ranks[:-1] = vocabulary.byte_pairs[flat[:-1], flat[1:]]
    ranks[ends - 1] = _NONE
    at = np.flatnonzero(ranks >= 0)
    at = at[np.argsort(ranks[at], kind="stable")]
    if not len(at):
        return {}
    filed = ranks[at]
    cuts = np.flatnonzero(np.diff(filed)) + 1
    firsts = filed[np.concatenate([[0], cuts])].tolist()
    return {rank: part.tolist() for rank, part in zip(firsts, np.split(at, cuts))}


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each non-empty word after all merges."""
    if not words:
        return []
    flat = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    index = _first_index(flat, ends, vocabulary)
    symbols = vocabulary.byte[flat].tolist()
    after = np.arange(1, len(flat) + 1)
    after[ends - 1] = _NONE
    before = np.arange(-1, len(flat) - 1)
    before[starts] = _NONE
    after, before = after.tolist(), before.tolist()
    rank_of, known = vocabulary.rank_of, vocabulary.known_pairs

    def file(position: int, pair: int) -> int:
        rank = known.get(pair)
        if rank is None:
            rank = rank_of(pair)
        if rank >= 0:
            held = index.get(rank)
            if held is None:
                index[rank] = [position]
                heapq.heappush(order, rank)
            else:
                held.append(position)
        return rank

    order = list(index)
    heapq.heapify(order)
    while order:
        rank = heapq.heappop(order)
        waiting: list[int] = []
        interrupted: set[int] = set()
        for at in sorted(index.pop(rank)):
            symbol = symbols[at]
            if symbol < 0:
                continue
            right = after[at]
            if right < 0 or rank_of(symbol << 32 | symbols[right]) != rank:
                continue
            if interrupted and bisect_right(starts, at) in interrupted:
                waiting.append(at)
                continue
            symbols[at], symbols[right] = rank, _NONE
            beyond, left = after[right], before[at]
            after[at] = beyond
            lower = False
            if beyond >= 0:
                before[beyond] = at
                lower = 0 <= file(at, rank << 32 | symbols[beyond]) < rank
            if left >= 0:
                lower = 0 <= file(left, symbols[left] << 32 | rank) < rank or lower
            if lower:
                interrupted.add(bisect_right(starts, at))
        if waiting:
            if rank in index:
                index[rank].extend(waiting)
            else:
                index[rank] = waiting
                heapq.heappush(order, rank)
    left_over = np.array(symbols)
    alive = left_over >= 0
    cuts = np.cumsum(alive)[ends - 1].tolist()
    ids = left_over[alive].tolist()
    return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


class Splitter:
    """Matches of the pattern, as the vocabulary's library finds them.

    The Unicode tables of the two pattern libraries differ in characters that are newer than
    Python's own tables. What such a character counts as is asked of the library, once for each.
    """

    def __init__(self, pattern: str):
        import regex

        self.pattern, self.compiled = pattern, regex.compile(pattern)
        self.stand_ins: dict[str, str] = {}

    def _stand_in(self, char: str) -> str:
        if char not in self.stand_ins:
            import tiktoken

            ranks = {bytes([b]): b for b in range(256)}
            own = char.encode()
            ranks |= {b"a" + own: 256, b"1" + own: 257}
            probe = tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            if probe.encode_ordinary("a" + char) == [256]:
                self.stand_ins[char] = "a"
            else:
                self.stand_ins[char] = "1" if probe.encode_ordinary("1" + char) == [257] else "$"
            if len(self.stand_ins) > 10_000:
                self.stand_ins = {char: self.stand_ins[char]}
        return self.stand_ins[char]

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.compiled.findall(text)
        new = {c for c in set(text) if unicodedata.category(c) == "Cn"}
        if not new:
            return self.compiled.findall(text)
        shown = text.translate({ord(c): self._stand_in(c) for c in new})
        return [text[m.start() : m.end()] for m in self.compiled.finditer(shown)]


class ReplayEncoder:
    """Ids of texts as little-endian 32-bit numbers; words seen before come from memory."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split = Vocabulary(path), Splitter(pattern)
        self.units, self.words = Recent(), Recent(REMEMBERED // 2)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """A word that is a token is its id; the others are replayed together."""
        raw = [w.encode() for w in words]
        ids = [self.vocabulary.ranks.get(w) for w in raw]
        todo = [i for i, known in enumerate(ids) if known is None]
        start, held = 0, 0
        for place, i in enumerate(todo):
            held += len(raw[i])
            if held >= REPLAY_BYTES or place + 1 == len(todo):
                part = todo[start : place + 1]
                for at, found in zip(part, replay([raw[j] for j in part], self.vocabulary)):
                    ids[at] = found
                start, held = place + 1, 0
        return [np.array(v, "<u4").tobytes() for v in ids]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """A unit's key is the word after a space, one after a line feed, or a text as it is."""
        split = self.split
        cut = [split(u[1:] if u[0] == ALONE else u if u[0] == "\n" else " " + u) for u in units]
        missing = {w for ws in cut for w in ws if w not in self.words}
        extra = self.words.learn(missing, self._encode_words) if missing else {}
        known = self.words.get
        raw = [b"".join([known(w) or extra[w] for w in ws]) for ws in cut]
        self.words.age()
        return raw

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = gathered(texts, (), self.units, self._encode_units, np.dtype("<u4"))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) as doc_id and ``ids``: little-endian 32-bit numbers.

    ``pattern`` cuts a text into the words that merge each on its own; a word that is itself a
    token stays whole. No special tokens are added or recognised. Null and empty texts have no
    ids. Rows that repeat stay, as do null ids; other columns are not read; an empty table gives
    none. Texts are worked on in groups of some million characters, one text of any length.
    ``ranks_path`` must exist on the executors. There is no shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("replay", ranks_path, pattern), lambda: ReplayEncoder(ranks_path, pattern))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, group in grouped_texts(texts, ENCODE_CHARS):
                gc.disable()  # millions of short-lived strings and no cycles among them
                ids = encoder(group)
                gc.enable()
                keys = batch.column(0).slice(start, len(group))
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, ids binary")


def decoded_bytes(raw: bytes, tokens: list[bytes]) -> bytes:
    """The bytes that little-endian 32-bit ids stand for."""
    return b"".join([tokens[t] for t in np.frombuffer(raw, "<u4").tolist()])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The columns doc_id and ``ids`` of ``encode`` with ``n_tokens`` and ``decoded``, the bytes.

    Null ids count as none. An id that is not in the vocabulary is an error.
    """
    ship(encoded.sparkSession)
    rows = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept(("tokens", ranks_path), lambda: Vocabulary(ranks_path)).tokens
        for batch in batches:
            start, held, counts, decoded = 0, 0, [], []
            for i, raw in enumerate(batch.column(1)):
                ids = raw.as_py()
                counts.append(len(ids) // 4)
                decoded.append(decoded_bytes(ids, tokens))
                held += counts[-1]
                if held >= DECODE_IDS or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    columns = [*part.columns, pa.array(counts, pa.int64()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "decoded"])
                    start, held, counts, decoded = i + 1, 0, [], []

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, ids binary, n_tokens bigint, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, from the ids and their decoding.

    One worker encodes, decodes what it encoded and hashes both, so that neither ids nor decoded
    bytes leave it. Rows are treated as by ``encode`` and ``decode``.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("replay", ranks_path, pattern), lambda: ReplayEncoder(ranks_path, pattern))
        tokens = encoder.vocabulary.tokens
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, group in grouped_texts(texts, ENCODE_CHARS):
                gc.disable()
                ids = encoder(group)
                gc.enable()
                counts = [len(x) // 4 for x in ids]
                digests = [hashlib.sha256(x).hexdigest() for x in ids]
                decoded = [hashlib.sha256(decoded_bytes(x, tokens)).hexdigest() for x in ids]
                keys = batch.column(0).slice(start, len(group))
                columns = [keys, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
