"""Phrases of two and three words that occur together more often than their parts suggest.

Mining follows SON. Documents fall into a few shards by their hash. Each shard is mined completely
at a support lowered in proportion to its share of all words: words first, then pairs of words
that are both frequent in the shard, then triples whose two pairs are. A phrase with the full
support reaches its share in at least one shard, so the union of what the shards report holds all
of them. A last pass counts these candidates, and with them all their parts, over all documents as
exact strings.

A shard is worked on by as many tasks as its size asks for. In the mining passes phrases are
64-bit hashes, summed in the task before they are shuffled; what a shard found frequent comes to
the next pass as a bit map of fixed size. Collisions there only add candidates, and the last pass
drops what lacks the support: a bit map that fills up costs time and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import grouped_texts, ship
from fathom.llm.rolling import BASES, Powers, mixed, word_hashes
from fathom.operators.ordering import running_totals
from fathom.sources.scratch import durable

SUPPORT = 10
LONGEST = 3
COVERED_PERCENT = 50
TOP = 2000
SHARDS = 4
# Bits of a map of frequent phrases, as a power of two: 16 MB.
MAP_BITS = 27
# Distinct phrases a task sums before it hands them on.
TALLY_ROWS = 500_000
# Letters of texts cut into words together.
CUT_CHARS = 1_000_000
# Parts of phrases with at least this share of all words are joined by broadcast: at most as many rows.
HOT_PARTS = 1000
UNKNOWN = "und"

_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" "
)
_END, _SPACE = 10, 32
_SHARD_BITS = 3


@dataclass
class Words:
    """The words of a group of texts: where they stand and hashes of their letters.

    ``follows[i]`` says that word i + 1 stands in the same piece as word i.
    """

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    follows: np.ndarray
    hashes: list[np.ndarray]


class Cutter:
    """Cuts texts into pieces and words, all texts of a group at once."""

    def __init__(self, hashes: int = 1):
        self.powers = [Powers(b) for b in BASES[:hashes]]

    def __call__(self, texts: list[str]) -> Words:
        held = [t.encode() for t in texts]
        raw = (b"\n".join(held) + b"\n").translate(_FOLD)
        letters = np.frombuffer(raw, np.uint8)
        ends_piece = letters == _END
        edge = np.diff(np.concatenate([[0], (~ends_piece & (letters != _SPACE)).view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(ends_piece, dtype=np.int64)[starts]
        limits = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
        hashes = []
        for which, powers in enumerate(self.powers):
            hashes.append(word_hashes(letters, starts, ends, which, powers))
        follows = piece[1:] == piece[:-1]
        return Words(raw, starts, ends, np.searchsorted(limits, starts, "right"), follows, hashes)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its first words and its last one; not symmetric."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))))


def _with_shard(codes: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """The hash with the shard in its lowest bits."""
    return (codes << np.uint64(_SHARD_BITS)) | shards


class Tally:
    """Sums counts by hash in sorted arrays of bounded length."""

    def __init__(self, most: int):
        self.most, self.parts, self.rows = most, [], 0

    def add(self, codes: np.ndarray) -> None:
        values, counts = np.unique(codes, return_counts=True)
        self.parts.append((values, counts))
        self.rows += len(values)
        if self.rows > 2 * self.most:
            self._merge()

    def _merge(self) -> None:
        codes = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.parts = [(codes[firsts], np.add.reduceat(counts, firsts))]
        self.rows = len(firsts)

    @property
    def full(self) -> bool:
        return self.rows > self.most and len(self.parts) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self._merge()
        codes, counts = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.rows = [], 0
        return codes, counts


def _seen(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes >> np.uint64(64 - MAP_BITS)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _documents(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, shard, text) of every row; equal texts fall into one shard."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"),
        F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias("shard"),
        text.alias("text"),
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, list[str]]]:
    """(langs, shards, texts) of a few texts at a time."""
    for batch in batches:
        langs, shards = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.uint64)
        for start, texts in grouped_texts(batch.column(2).to_pylist(), CUT_CHARS):
            yield langs[start : start + len(texts)], shards[start : start + len(texts)], texts


def _lang_codes(langs: list[str]) -> list[np.ndarray]:
    """Two numbers for the language of each text that depend on its letters alone."""
    codes = {x: np.frombuffer(blake2b(x.encode(), digest_size=16).digest(), "<u8") for x in set(langs)}
    return list(np.array([codes[x] for x in langs], np.uint64).reshape(len(langs), 2).T)


def _chains(words: Words, langs: list[np.ndarray], which: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: (first word of every occurrence, hash of the phrase)."""
    single = words.hashes[which] ^ langs[which][words.text]
    found = [(np.arange(len(single)), single)]
    first = np.arange(len(single))
    code = single
    for length in range(2, LONGEST + 1):
        last = first + (length - 2)
        goes_on = last < len(single) - 1
        goes_on[goes_on] = words.follows[last[goes_on]]
        first, code, last = first[goes_on], code[goes_on], last[goes_on]
        code = _joined(code, words.hashes[which][last + 1])
        found.append((first, code))
    return found


def _word_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of single words."""
    cut, tallies = Cutter(), {}
    for langs, shards, texts in _groups(batches):
        words = cut(texts)
        codes = _with_shard(words.hashes[0] ^ _lang_codes(langs)[0][words.text], shards[words.text])
        names = sorted(set(langs))
        place = {x: i for i, x in enumerate(names)}
        of = np.fromiter((place[x] for x in langs), np.int64, len(langs))[words.text]
        for i, lang in enumerate(names):
            tally = tallies.setdefault(lang, Tally(TALLY_ROWS))
            tally.add(codes[of == i])
            if tally.full:
                yield from _rows(tally, lang)
        if len(tallies) > 64:  # languages may be any text
            for lang, tally in tallies.items():
                yield from _rows(tally, lang)
            tallies = {}
    for lang, tally in tallies.items():
        yield from _rows(tally, lang)


def _rows(tally: Tally, lang: str | None = None) -> Iterator[pa.RecordBatch]:
    codes, counts = tally.take()
    for at in range(0, len(codes), 100_000):
        part = [pa.array(codes[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000])]
        if lang is None:
            yield pa.RecordBatch.from_arrays(part, names=["code", "n"])
        else:
            named = pa.array([lang] * len(part[0]), pa.string())
            yield pa.RecordBatch.from_arrays([named, *part], names=["lang", "code", "n"])


def _phrase_tallies(length: int, known):
    """(code, n) of phrases whose parts without the last and without the first word are frequent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, tally, bits = Cutter(), Tally(TALLY_ROWS), np.frombuffer(known.value, np.uint8)
        for langs, shards, texts in _groups(batches):
            words = cut(texts)
            own = _lang_codes(langs)
            chains = _chains(words, own)
            (part_first, part), (first, code) = chains[length - 2], chains[length - 1]
            frequent = np.zeros(len(words.starts) + 1, bool)
            frequent[part_first] = _seen(bits, _with_shard(part, shards[words.text[part_first]]))
            kept = frequent[first] & frequent[first + 1]
            tally.add(_with_shard(code[kept], shards[words.text[first[kept]]]))
            if tally.full:
                yield from _rows(tally)
        yield from _rows(tally)

    return work


class PhraseTally:
    """Counts of phrases with their letters, summed over groups of texts.

    Phrases are told apart by 128 bits: a hash that orders them and a second one that is compared.
    Letters are copied once for each phrase.
    """

    def __init__(self):
        self.langs: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.codes = self.checks = none.view(np.uint64)
        self.counts = self.lang = self.size = self.place = none
        self.letters: list[pa.Array] = []
        self.rows = 0

    def add(self, words: Words, langs: np.ndarray, length: int, first: np.ndarray, code: np.ndarray, check: np.ndarray) -> bool:
        """Add phrases of ``length`` words that start at the words ``first``; ``langs`` are those of
        the texts. False, and nothing added, if two phrases share the first 64 bits."""
        if not len(first):
            return True
        order = np.argsort(code)
        code, check, first = code[order], check[order], first[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = code[1:] != code[:-1]
        if (~fresh[1:] & (check[1:] != check[:-1])).any():
            return False
        at = np.flatnonzero(fresh)
        counts = np.diff(np.append(at, len(code)))
        code, check, first = code[at], check[at], first[at]
        place = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[place] == code if len(self.codes) else np.zeros(len(code), bool)
        if (self.checks[place[known]] != check[known]).any():
            return False
        self.counts[place[known]] += counts[known]
        new = ~known
        first = first[new]
        self.letters.append(_spelled(words, first, length))
        parts = (
            (self.codes, code[new]),
            (self.checks, check[new]),
            (self.counts, counts[new]),
            (self.lang, langs[words.text[first]]),
            (self.size, np.full(len(first), length)),
            (self.place, self.rows + np.arange(len(first))),
        )
        self.rows += len(first)
        joined = [np.concatenate(p) for p in parts]
        order = np.argsort(joined[0])
        self.codes, self.checks, self.counts, self.lang, self.size, self.place = (x[order] for x in joined)
        return True

    def take(self) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, words, n) of all phrases; the sums start anew."""
        if self.rows:
            names = pa.array(list(self.langs), pa.string())
            letters = pa.concat_arrays(self.letters)
            for at in range(0, self.rows, 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(self.lang[part])),
                        letters.take(pa.array(self.place[part])),
                        pa.array(self.size[part].astype(np.int32)),
                        pa.array(self.counts[part]),
                    ],
                    names=_COUNTED,
                )
        self._clear()


_COUNTED = ["lang", "phrase", "words", "n"]


def _spelled(words: Words, first: np.ndarray, length: int) -> pa.Array:
    """The phrases from the words ``first`` on, with single spaces."""
    last = first + (length - 1)
    starts, ends = words.starts[first], words.ends[last]
    apart = np.zeros(len(words.starts), np.int64)
    apart[1:] = words.starts[1:] - words.ends[:-1] - 1
    wide = np.zeros(len(first), bool)
    for step in range(1, length):
        wide |= apart[first + step] > 0
    sizes = np.where(wide, 0, ends - starts)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    letters = np.frombuffer(words.raw, np.uint8)[at]
    plain = pa.StringArray.from_buffers(
        len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters))
    )
    if not wide.any():
        return plain
    # More than one space between words: joined one by one.
    own = words.raw
    joined = [
        b" ".join([own[words.starts[j] : words.ends[j]] for j in range(i, i + length)]).decode() if w else None
        for i, w in zip(first.tolist(), wide.tolist())
    ]
    return pc.if_else(pa.array(wide), pa.array(joined, pa.string()), plain)


def _by_letters(words: Words, langs: list[str], length: int, first: np.ndarray) -> pa.RecordBatch:
    """The same counts without hashes."""
    phrases = _spelled(words, first, length).to_pylist()
    exact: dict = {}
    for key in zip((langs[t] for t in words.text[first].tolist()), phrases):
        exact[key] = exact.get(key, 0) + 1
    rows = [(lang, phrase, length, n) for (lang, phrase), n in exact.items()]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_COUNTED)


def _candidate_counts(known):
    """(lang, phrase, words, n) of every occurrence of a candidate, summed in a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, bits, tally = Cutter(hashes=2), np.frombuffer(known.value, np.uint8), PhraseTally()
        for langs, _, texts in _groups(batches):
            words = cut(texts)
            own = _lang_codes(langs)
            numbers = np.array([tally.langs.setdefault(x, len(tally.langs)) for x in langs], np.int64)
            for length, ((first, code), (_, check)) in enumerate(zip(_chains(words, own), _chains(words, own, 1)), 1):
                kept = _seen(bits, code << np.uint64(_SHARD_BITS))
                if length > 1:
                    # A frequent phrase has frequent parts.
                    kept &= candidate[first] & candidate[first + 1]
                first, code, check = first[kept], code[kept], check[kept]
                candidate = np.zeros(len(words.starts) + 1, bool)
                candidate[first] = True
                if not tally.add(words, numbers, length, first, code, check):
                    yield _by_letters(words, langs, length, first)
            if tally.rows > TALLY_ROWS:
                yield from tally.take()
                tally.langs = {}
        yield from tally.take()

    return work


def _bit_map(codes: DataFrame) -> bytes:
    """A map of fixed size with a bit for the highest ``MAP_BITS`` bits of each hash.

    At most one row for each 64 bits of the map reaches the driver, whatever the number of hashes.
    """
    at = F.shiftrightunsigned("code", 64 - MAP_BITS)
    one = F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")
    words = codes.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("place")).agg(F.bit_or(one).alias("bits"))
    table = words.toArrow()
    held = np.zeros(1 << (MAP_BITS - 6), np.int64)
    held[table["place"].to_numpy()] = table["bits"].to_numpy()
    return held.tobytes()


def _supported(tallies: DataFrame, weights: Column, support: int) -> DataFrame:
    """(code) of the hashes that reach their shard's part of the support."""
    sums = tallies.groupBy("code").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= support * weights).select("code")


def _weight(sizes: dict[int, int]) -> Column:
    """The share of a hash's shard of all words, with a margin for rounding."""
    total = max(1, sum(sizes.values()))
    shares = F.create_map(*(F.lit(x) for s in range(1 << _SHARD_BITS) for x in (s, sizes.get(s, 0) / total * (1 - 1e-9))))
    return F.element_at(shares, (F.col("code").bitwiseAND((1 << _SHARD_BITS) - 1)).cast("int"))


@dataclass
class PhraseCounts:
    """Exact counts of all words and phrases with the support, and of all words of a language."""

    phrases: DataFrame  # lang, phrase, words, n
    totals: DataFrame  # lang, n


def count_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> PhraseCounts:
    """Every phrase of one to three words with at least ``support`` occurrences in its language.

    A null text is empty and a null language is ``und``; documents without words add nothing.
    Rows that repeat count again. Columns besides text and lang are not read; an empty table
    gives empty ones.
    """
    if not 1 <= shards <= 1 << _SHARD_BITS:
        raise ValueError(f"shards must be from 1 to {1 << _SHARD_BITS}")
    spark = docs.sparkSession
    ship(spark)
    rows = _documents(docs, shards)
    singles = durable(
        rows.mapInArrow(_word_tallies, "lang string, code bigint, n bigint")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n")),
        "phrase-words",
    )
    totals = durable(singles.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    in_shard = F.col("code").bitwiseAND((1 << _SHARD_BITS) - 1).alias("shard")
    weight = _weight({r["shard"]: r["n"] for r in singles.groupBy(in_shard).agg(F.sum("n").alias("n")).collect()})
    found = [durable(singles.filter(F.col("n") >= support * weight).select("code"), "phrase-frequent")]
    for length in range(2, LONGEST + 1):
        known = spark.sparkContext.broadcast(_bit_map(found[-1]))
        tallies = rows.mapInArrow(_phrase_tallies(length, known), "code bigint, n bigint")
        found.append(durable(_supported(tallies, weight, support), "phrase-frequent"))
    union = found[0]
    for more in found[1:]:
        union = union.union(more)
    # The same hash without its shard: candidates are counted in all shards.
    plain = union.select((F.shiftleft(F.shiftrightunsigned("code", _SHARD_BITS), _SHARD_BITS)).alias("code"))
    known = spark.sparkContext.broadcast(_bit_map(plain))
    counted = rows.mapInArrow(_candidate_counts(known), "lang string, phrase string, words int, n bigint")
    exact = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return PhraseCounts(durable(exact.filter(F.col("n") >= support), "phrase-counts"), totals)


def _with_part_counts(parts: DataFrame, counts: PhraseCounts) -> DataFrame:
    """``parts`` (lang, part, …) with ``f``, the count of the part; every part has one.

    Words that make up a large share of all stand in very many phrases. There are only
    ``HOT_PARTS`` of them at most, so they are joined by broadcast; any other part stands in few
    phrases and is joined by its hash.
    """
    f = counts.phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    words = counts.totals.agg(F.sum("n")).first()[0] or 0
    hot = durable(f.filter(F.col("f") * HOT_PARTS >= words), "phrase-hot")
    tried = parts.join(F.broadcast(hot), ["lang", "part"], "left")
    cold = tried.filter("f IS NULL").drop("f").join(f, ["lang", "part"])
    return tried.filter("f IS NOT NULL").unionByName(cold)


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    covered_percent: int = COVERED_PERCENT,
    top: int | None = TOP,
    shards: int = SHARDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the strongest phrases of two to three words.

    Texts (A-Z lower-cased) are cut into pieces at ``.,;:!?`` and line ends and into words at
    spaces and tabs. a, l, r count the phrase and the two parts of its weakest cut, n all words of
    the language; score is floor(1000000 a a / (l r)) for that cut, of equal ones the first. A
    phrase is left out if a longer one with the support holds its words and has at least
    ``covered_percent`` of its count. Ranks go by score, a (both descending) and phrase in byte
    order; ``top`` of None keeps all. Products are decimals of 38 digits: exact for counts up to
    10^16. Nulls, empty and repeated rows: see ``count_phrases``.
    """
    counts = count_phrases(docs, support, shards)
    phrases = counts.phrases.filter("words > 1").withColumnRenamed("n", "a")
    parted = phrases.withColumn("_w", F.split("phrase", " "))
    held = parted.filter("words > 2").select(
        "lang",
        F.col("a").alias("longer"),
        F.explode(
            F.array(
                F.concat_ws(" ", F.expr("slice(_w, 1, words - 1)")),
                F.concat_ws(" ", F.expr("slice(_w, 2, words - 1)")),
            )
        ).alias("phrase"),
    )
    longest = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = parted.join(longest, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a"))
    )
    cuts = left.select(
        "lang",
        "phrase",
        "a",
        F.explode(
            F.expr(
                "flatten(transform(sequence(1, words - 1), k -> array("
                "named_struct('k', k, 'side', 0, 'part', concat_ws(' ', slice(_w, 1, k))), "
                "named_struct('k', k, 'side', 1, 'part', concat_ws(' ', slice(_w, k + 1, words - k))))))"
            )
        ).alias("c"),
    ).select("lang", "phrase", "a", "c.*")
    sides = _with_part_counts(cuts, counts).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"),
        F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"),
    )
    a, l, r = (f"CAST({c} AS DECIMAL(16,0))" for c in "alr")
    score = F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST({a} * {a} AS DECIMAL(32,0)) div ({l} * {r})")
    weakest = (
        sides.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
        .select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    )
    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    # Places in one sorted pass over all languages, none of which needs to fit into one task.
    placed = running_totals(weakest, order, {"place": F.lit(1).cast("bigint")})
    ahead = placed.groupBy("lang").agg((F.min("place") - 1).alias("ahead"))
    ranked = placed.join(ahead, "lang").withColumn("rank", F.col("place") - F.col("ahead"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(counts.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT i, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
occ AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(list_slice(w, s, s + k - 1), ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM occ GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
held AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM c WHERE k = 3),
open AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM held GROUP BY ALL) h USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w, k FROM open),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, fl.f AS l, fr.f AS r,
  ((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (fl.f::HUGEINT * fr.f::HUGEINT))::BIGINT AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = array_to_string(w[1:cut], ' ')
  JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT lang, phrase, a, min({'score': score, 'k': cut, 'l': l, 'r': r}) AS c FROM scored GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY c.score DESC, a DESC, phrase) AS rank,
  phrase, a, c.l AS l, c.r AS r, c.score AS score FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
