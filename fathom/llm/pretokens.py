"""Cutting texts into units whose tokens do not depend on what stands around them.

The byte-level pattern never lets a pre-token run over a space that a non-space follows, nor over
a single line feed between non-spaces. A text whose white space is only such spaces and line feeds
is cut there at the speed of ``str.split``; any other text is one unit. Both give the same tokens
as the whole text, and a unit that was seen before costs one dictionary lookup.

Units go by keys: a plain word stands for the word after a space, one that starts with a line
feed for itself, and what follows ``ALONE`` is a text, or its first word, as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress
from operator import not_
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ALONE = "\0"
# Units remembered by a worker process: two generations of at most this many each.
REMEMBERED = 400_000
# Longer units are not remembered.
LONGEST_REMEMBERED = 200
# Units are joined to texts of about this many characters for one call of the library's splitter.
JOINED_CHARS = 200_000


class Recent(dict):
    """A dictionary that forgets what was not used for long; bounded in entries."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.most, self.old = most, {}

    def learn(self, missing: set[str], compute: Callable[[list[str]], list[Any]]) -> dict[str, Any]:
        """Add keys that are not present; what is too long to remember comes back."""
        old, wanted, extra = self.old, [], {}
        for key in missing:
            value = old.get(key)
            if value is None:
                wanted.append(key)
            else:
                self[key] = value
        for key, value in zip(wanted, compute(wanted) if wanted else []):
            (self if len(key) <= LONGEST_REMEMBERED else extra)[key] = value
        return extra

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def units(text: str, specials: tuple[str, ...] = ()) -> list[str]:
    """Keys of the parts of ``text`` that are tokenized on their own."""
    if not text:
        return []
    if not _plain(text, specials):
        return [ALONE + text]
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = ALONE + parts[0]
    return parts


def per_text(texts: list[str], specials: tuple[str, ...], memory: Recent, compute) -> list[list[Any]]:
    """For every text the values of its units; ``compute`` gives true values for new units."""
    cut = [units(t, specials) for t in texts]
    known = memory.get
    values = [list(map(known, us)) for us in cut]
    missing: set[str] = set()
    for us, found in zip(cut, values):
        missing.update(compress(us, map(not_, found)))
    if missing:
        extra = memory.learn(missing, compute)
        for us, found in zip(cut, values):
            for i in list(compress(range(len(us)), map(not_, found))):
                found[i] = known(us[i]) or extra[us[i]]
    memory.age()
    return values


def _plain(text: str, specials: tuple[str, ...]) -> bool:
    """Is all white space in the text single spaces and line feeds between other characters?"""
    flat = text.replace("\n", " ")
    # Of all white space only the space is printable.
    plain = flat.isprintable() and "  " not in flat and flat[0] != " " and flat[-1] != " "
    return plain and not any(s in text for s in specials)


def gathered(
    texts: list[str], specials: tuple[str, ...], memory: Recent, compute, dtype: np.dtype
) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts one after another, and where each text's end.

    ``compute`` gives a unit's numbers as bytes, never empty. Texts are cut and their units made
    distinct by columns: Python only sees each distinct unit of a group once, and the texts are
    put together by one gather.
    """
    plain = np.fromiter((bool(t) and _plain(t, specials) for t in texts), bool, len(texts))
    marked = [ALONE + t.replace("\n", " \n") for t, p in zip(texts, plain.tolist()) if p]
    cut = pc.split_pattern(pa.array(marked, pa.string()), " ")
    coded = cut.values.dictionary_encode()
    keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    alone = [ALONE + t for t, p in zip(texts, plain.tolist()) if t and not p]
    counts = np.fromiter(map(bool, texts), np.int64, len(texts))
    counts[plain] = np.diff(cut.offsets.to_numpy())
    units = np.empty(counts.sum(), np.int64)
    from_plain = np.repeat(plain, counts)
    units[from_plain] = coded.indices.to_numpy()
    units[~from_plain] = len(keys) + np.arange(len(alone))
    keys += alone
    values = list(map(memory.get, keys))
    missing = set(compress(keys, map(not_, values)))
    if missing:
        extra = memory.learn(missing, compute)
        known = memory.get
        for i in list(compress(range(len(keys)), map(not_, values))):
            values[i] = known(keys[i]) or extra[keys[i]]
    memory.age()
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // dtype.itemsize
    flat = np.frombuffer(b"".join(values), dtype)
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[units]
    ends = np.cumsum(lengths)
    at = np.repeat(starts[units] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], np.append(0, ends)[np.cumsum(counts)]


# Letters up to here are letters in every version of Unicode.
LAST_LETTER = "\u00ff"
_spelled: dict[int, str] = {}


def spelled_letters(splitter) -> dict[int, str]:
    """How the splitter writes the bytes of the letters beyond ASCII, for ``str.translate``."""
    if not _spelled:
        codes = [c for c in range(0x80, ord(LAST_LETTER) + 1) if chr(c).isalpha()]
        _spelled.update((c, splitter.pre_tokenize_str(chr(c))[0][0]) for c in codes)
    return _spelled


def split_units(splitter, keys: list[str]) -> list[list[str]]:
    """The pre-tokens of every unit.

    A word of plain letters, alone or before a comma or full stop, is one pre-token with its space.
    Others after a space or line feed are joined to long texts for few calls of the library's
    splitter, each of which costs more than a unit; no pre-token crosses a joint.
    """
    found: list[list[str]] = [[] for _ in keys]
    held: list[tuple[list[str], str]] = []
    letters = spelled_letters(splitter)
    space, feed = (splitter.pre_tokenize_str(c)[0][0] for c in " \n")
    chars = 0

    def flush() -> None:
        pieces = iter(splitter.pre_tokenize_str("".join([text for _, text in held])))
        end = 0
        for own, text in held:
            end += len(text)
            for piece, (_, stop) in pieces:
                own.append(piece)
                if stop == end:
                    break

    for own, key in zip(found, keys):
        if key[0] == ALONE:
            own.extend([piece for piece, _ in splitter.pre_tokenize_str(key[1:])])
            continue
        word = key[1:] if key[0] == "\n" else key
        mark = word[-1] if word[-1] in ",." else ""
        if mark:
            word = word[:-1]
        if word.isalpha() and (word.isascii() or max(word) <= LAST_LETTER):
            spelled = word if word.isascii() else word.translate(letters)
            if key[0] == "\n":
                own.append(feed)
                own.append(spelled)
            else:
                own.append(space + spelled)
            if mark:
                own.append(mark)
            continue
        held.append((own, key if key[0] == "\n" else " " + key))
        chars += len(key) + 1
        if chars >= JOINED_CHARS:
            flush()
            held, chars = [], 0
    if held:
        flush()
    return found


def values_of(pieces: list[list[str]], memory: Recent, compute) -> list[list[Any]]:
    """For every unit the values of its pre-tokens, remembered like units."""
    missing = {p for ps in pieces for p in ps if p not in memory}
    extra = memory.learn(missing, compute) if missing else {}
    known = memory.get
    if extra:
        found = [[extra.get(p) or known(p) for p in ps] for ps in pieces]
    else:
        found = [list(map(known, ps)) for ps in pieces]
    memory.age()
    return found
