"""Token ids in binary shards with a minimal perfect hash index over document keys.

A shard (``shard-00000.ids``) holds the raw ids of consecutive documents in ascending key order:

    8 bytes   b"FTOK", version, bytes per id (2 or 4), two zero bytes
    ids       little-endian, every document closed by the end id
    offsets   rows + 1 unsigned 64-bit numbers: where each document's ids start, counted in ids
    16 bytes  rows, ids (unsigned 64-bit)

The index (``index-00000.mph``, one file for each bucket of keys) maps a key to its shard and row.
Its hash is minimal and perfect: keys fall on bits of a level; a bit hit by one key is its place,
keys that collide go on to the next level. A key's slot is the rank of its bit, read from one
stored count and one 64-bit word, so access takes constant time. The slot holds a 32-bit
fingerprint that turns unknown keys away, then shard, row and number of rows of the key.

Files are written under a name of their own attempt and renamed, and their content only depends on
the input: a task that runs twice does no harm. Rows of one key are neighbours in one shard.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fathom.llm.common import grouped_texts, kept, ship
from fathom.llm.pretokens import ALONE, JOINED_CHARS, LAST_LETTER, REMEMBERED, Recent, gathered, spelled_letters
from fathom.sources.scratch import durable, scratch_path

END_ID = 0
MAGIC = b"FTOK"
# Keys of one index file.
KEYS_PER_INDEX = 200_000
# Bits of a level for each key that reaches it.
GAMMA = 2.0
_LEVELS = 256


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def _write_file(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    attempt = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(attempt, f"{root}/{name}")


def _read_file(folder: str, name: str) -> bytes:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/{name}") as source:
        return source.read()


def shard_name(shard: int) -> str:
    return f"shard-{shard:05d}.ids"


def index_name(bucket: int) -> str:
    return f"index-{bucket:05d}.mph"


class Encoder:
    """Ids of texts as raw bytes; units seen before come from memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.specials = tuple(t["content"] for t in json.load(file)["added_tokens"])
        width = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if width <= 1 << 16 else "<u4")
        self.units, self.pieces = Recent(), Recent(REMEMBERED // 2)
        self.pack = "H" if self.dtype.itemsize == 2 else "I"
        splitter, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.letters = spelled_letters(splitter)
        self.space, feed = (splitter.pre_tokenize_str(c)[0][0] for c in " \n")
        ids = {c: array(self.pack, [t.id for t in model.tokenize(c)]).tobytes() for c in (feed, ",", ".")}
        self.feed, self.marks = ids[feed], {c: ids[c] for c in ",."}

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Words of plain letters, alone or before a comma or full stop, are one pre-token with their
        space and go to the library's model, once for each word. Other units after a space or line
        feed are joined for few calls of the library, and cut apart by where its tokens start; no
        token crosses a joint. The rest is encoded as it is."""
        raw: list[bytes] = [b""] * len(units)
        held: list[int] = []
        chars = 0
        pieces, known, older = self.pieces, self.pieces.get, self.pieces.old.get
        space, feed, marks, letters = self.space, self.feed, self.marks, self.letters
        tokenize, pack = self.tokenizer.model.tokenize, self.pack
        for i, unit in enumerate(units):
            first = unit[0]
            if first == ALONE:
                ids = self.tokenizer.encode(unit[1:], add_special_tokens=False).ids
                raw[i] = array(pack, ids).tobytes()
                continue
            word = unit[1:] if first == "\n" else unit
            mark = marks.get(word[-1])
            core = word if mark is None else word[:-1]
            if core.isalpha() and (core.isascii() or max(core) <= LAST_LETTER):
                piece = core if core.isascii() else core.translate(letters)
                if first != "\n":
                    piece = space + piece
                value = known(piece)
                if value is None:
                    value = older(piece) or array(pack, [t.id for t in tokenize(piece)]).tobytes()
                    pieces[piece] = value
                if first == "\n":
                    value = feed + value
                raw[i] = value if mark is None else value + mark
                continue
            held.append(i)
            chars += len(unit) + 1
            if chars >= JOINED_CHARS:
                self._encode_joined(units, held, raw)
                held, chars = [], 0
        self._encode_joined(units, held, raw)
        pieces.age()
        return raw

    def _encode_joined(self, units: list[str], held: list[int], raw: list[bytes]) -> None:
        if not held:
            return
        parts = [units[i] if units[i][0] == "\n" else " " + units[i] for i in held]
        starts = np.cumsum([0, *map(len, parts[:-1])])
        found = self.tokenizer.encode("".join(parts), add_special_tokens=False)
        ids = np.array(found.ids, self.dtype).tobytes()
        of = np.searchsorted(starts, np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
        ends = (np.cumsum(np.bincount(of, minlength=len(parts))) * self.dtype.itemsize).tolist()
        for i, a, b in zip(held, [0, *ends], ends):
            raw[i] = ids[a:b]

    def gathered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        return gathered(texts, self.specials, self.units, self._encode_units, self.dtype)

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.gathered(texts)
        starts = np.append(0, ends[:-1])
        return [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


# --- minimal perfect hash -------------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit numbers for every seed (the splitmix64 finisher)."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the index of distinct ``keys`` (uint64); row i of ``places`` belongs to key i."""
    words, sizes = [], []
    left = np.arange(len(keys))
    slots = np.zeros(len(keys), np.int64)
    used = 0
    while len(left):
        if len(sizes) == _LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
        at = (_mixed(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[placed]] = used + rank[at[placed]]
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        used += int(alone.sum())
        sizes.append(size)
        left = left[~placed]
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    counts = np.bitwise_count(bits).astype(np.int64)
    checks = np.zeros(len(keys), np.uint32)
    checks[slots] = _check(keys)
    stored = np.zeros(places.shape, np.int64)
    stored[slots] = places
    return {
        "sizes": np.array(sizes, np.int64),
        "bits": bits,
        "before": (np.cumsum(counts) - counts).astype(np.int64),
        "checks": checks,
        "places": stored,
    }


def find(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 for a key that the fingerprint turns away."""
    slots = np.full(len(keys), -1, np.int64)
    todo = np.arange(len(keys))
    base = 0
    for level, size in enumerate(index["sizes"].tolist()):
        at = (_mixed(keys[todo], level) % np.uint64(size)).astype(np.int64)
        word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
        value = index["bits"][word]
        hit = (value >> bit) & np.uint64(1) == 1
        below = value & ((np.uint64(1) << bit) - np.uint64(1))
        slots[todo[hit]] = index["before"][word[hit]] + np.bitwise_count(below[hit])
        todo = todo[~hit]
        base += size >> 6
    known = slots >= 0
    known[known] = index["checks"][slots[known]] == _check(keys[known])
    return np.where(known, slots, -1)


def _packed(arrays: dict[str, np.ndarray], note: dict) -> Iterator[bytes]:
    head = json.dumps(
        {"note": note, "arrays": [[n, a.dtype.str, list(a.shape)] for n, a in arrays.items()]}
    ).encode()
    yield len(head).to_bytes(8, "little") + head
    for array in arrays.values():
        yield np.ascontiguousarray(array).tobytes()


def _unpacked(raw: bytes) -> tuple[dict[str, np.ndarray], dict]:
    size = int.from_bytes(raw[:8], "little")
    head, at, arrays = json.loads(raw[8 : 8 + size]), 8 + size, {}
    for name, dtype, shape in head["arrays"]:
        arrays[name] = np.frombuffer(raw, dtype, int(np.prod(shape)), at).reshape(shape)
        at += arrays[name].nbytes
    return arrays, head["note"]


# --- access to one key by places in the files -----------------------------------------------


def _opened(folder: str, name: str):
    store, root = _store(folder)
    return store.open_input_file(f"{root}/{name}")


def _numbers(file, at: int, dtype: str, count: int) -> np.ndarray:
    return np.frombuffer(file.read_at(count * np.dtype(dtype).itemsize, at), dtype, count)


def _bucket_of(doc_id: int | None, buckets: int) -> int:
    """The bucket that ``pmod(xxhash64(doc_id), buckets)`` gives; a null hashes to its seed."""
    import xxhash

    value = 42
    if doc_id is not None:
        value = xxhash.xxh64_intdigest((doc_id & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), seed=42)
    value -= (value >> 63) << 64
    return value % buckets


def _place_in(file, doc_id: int | None) -> list[int] | None:
    """(shard, row, copies) of a key: one bit word for each level it is tried on, then one count,
    one fingerprint and one place."""
    size = int(_numbers(file, 0, "<u8", 1)[0])
    head, at = json.loads(file.read_at(size, 8)), 8 + size
    if doc_id is None:
        return head["note"]["null"]
    starts: dict[str, tuple[int, str, list[int]]] = {}
    for name, dtype, shape in head["arrays"]:
        starts[name] = (at, dtype, shape)
        at += int(np.prod(shape)) * np.dtype(dtype).itemsize
    key = np.array([doc_id], np.int64).view(np.uint64)
    base = 0
    levels, dtype, shape = starts["sizes"]
    for level, length in enumerate(_numbers(file, levels, dtype, shape[0]).tolist()):
        bit = int(_mixed(key, level)[0]) % length
        word = base + (bit >> 6)
        value = int(_numbers(file, starts["bits"][0] + 8 * word, "<u8", 1)[0])
        if value >> (bit & 63) & 1:
            below = (value & ((1 << (bit & 63)) - 1)).bit_count()
            slot = int(_numbers(file, starts["before"][0] + 8 * word, "<i8", 1)[0]) + below
            if _numbers(file, starts["checks"][0] + 4 * slot, "<u4", 1)[0] != _check(key)[0]:
                return None
            return _numbers(file, starts["places"][0] + 24 * slot, "<i8", 3).tolist()
        base += length >> 6
    return None


def _rows_in(file, row: int, copies: int) -> list[np.ndarray]:
    head = file.read_at(8, 0)
    if head[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    end = file.size()
    rows = int(_numbers(file, end - 16, "<u8", 1)[0])
    offsets = _numbers(file, end - 16 - 8 * (rows + 1) + 8 * row, "<u8", copies + 1).astype(np.int64)
    ids = _numbers(file, 8 + int(offsets[0]) * head[5], f"<u{head[5]}", int(offsets[-1] - offsets[0]))
    return [ids[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets, offsets[1:])]


# --- shards ---------------------------------------------------------------------------------


class Shard:
    """A shard's rows."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        rows, ids = np.frombuffer(raw, "<u8", 2, len(raw) - 16).tolist()
        self.ids = np.frombuffer(raw, f"<u{raw[5]}", ids, 8)
        self.offsets = np.frombuffer(raw, "<u8", rows + 1, len(raw) - 16 - 8 * (rows + 1)).astype(np.int64)

    def row(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


_ENTRY = "doc_id bigint, shard int, row bigint, copies bigint, ids bigint"


def _write_shards(tokenizer_path: str, folder: str, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task's rows become one shard; a row for each key says where it is."""
        from pyspark import TaskContext

        encode = encoder(tokenizer_path)
        shard = TaskContext.get().partitionId()
        keys: list[int | None] = []
        lengths: list[int] = []

        def chunks() -> Iterator[bytes]:
            yield MAGIC + bytes([1, encode.dtype.itemsize, 0, 0])
            for batch in batches:
                keys.extend(batch.column(0).to_pylist())
                for _, texts in grouped_texts(batch.column(1).to_pylist()):
                    ids, ends = encode.gathered(texts)
                    yield np.insert(ids, ends, end_id).tobytes()
                    lengths.extend((np.diff(ends, prepend=0) + 1).tolist())
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<u8")
            yield offsets.tobytes()
            yield np.array([len(lengths), offsets[-1]], "<u8").tobytes()

        _write_file(folder, shard_name(shard), chunks())
        if keys:
            firsts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            stops = [*firsts[1:], len(keys)]
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in firsts], pa.int64()),
                    pa.array([shard] * len(firsts), pa.int32()),
                    pa.array(firsts, pa.int64()),
                    pa.array([b - a for a, b in zip(firsts, stops)], pa.int64()),
                    pa.array([int(ends[b] - ends[a]) for a, b in zip(firsts, stops)], pa.int64()),
                ],
                names=["doc_id", "shard", "row", "copies", "ids"],
            )

    return work


def _build_indexes(folder: str):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        known = table.filter(table["doc_id"].is_valid())
        none = table.filter(table["doc_id"].is_null()).select(["shard", "row", "copies"]).to_pylist()
        places = np.stack([known[c].to_numpy().astype(np.int64) for c in ("shard", "row", "copies")], axis=1)
        index = build_index(known["doc_id"].to_numpy().astype(np.int64).view(np.uint64), places)
        note = {"null": [none[0]["shard"], none[0]["row"], none[0]["copies"]] if none else None}
        _write_file(folder, index_name(key[0].as_py()), _packed(index, note))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([len(table)], pa.int64())})

    return work


def _find_places(folder: str):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        index, note = _unpacked(_read_file(folder, index_name(key[0].as_py())))
        wanted = table["doc_id"].combine_chunks()
        ids = wanted.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        null = wanted.is_null().to_numpy(zero_copy_only=False)
        slots = find(index, ids.view(np.uint64))
        places = np.zeros((len(ids), 3), np.int64)
        hit = (slots >= 0) & ~null
        places[hit] = index["places"][slots[hit]]
        if note["null"] is not None:
            places[null] = note["null"]
            hit = hit | null
        columns = [pa.array(places[hit, i], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        return pa.table([wanted.filter(pa.array(hit)), *columns], names=["doc_id", "shard", "row", "copies"])

    return work


def _read_rows(folder: str):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        shard = Shard(_read_file(folder, shard_name(number)))
        out: list[tuple] = []
        for doc_id, row, copies in zip(*(table[c].to_pylist() for c in ("doc_id", "row", "copies"))):
            for i in range(row, row + copies):
                ids = shard.row(i)
                out.append((doc_id, number, int(shard.offsets[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.table(columns, names=["doc_id", "shard", "offset", "n_tokens", "ids_crc32"])

    return work


@dataclass
class TokenFiles:
    """A written set: its folder, one row per shard (shard, base, docs, ids), index buckets."""

    folder: str
    shards: DataFrame
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def places(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, row, copies) of the keys that the index knows, each once."""
        wanted = keys.select("doc_id").distinct().withColumn("bucket", self.bucket())
        return wanted.groupBy("bucket").applyInArrow(
            _find_places(self.folder), "doc_id bigint, shard int, row bigint, copies bigint"
        )

    def rows(self, keys: DataFrame) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every stored row of the keys, read from the files."""
        read = self.places(keys).groupBy("shard").applyInArrow(
            _read_rows(self.folder),
            "doc_id bigint, shard int, offset bigint, n_tokens bigint, ids_crc32 bigint",
        )
        return read.join(self.shards.select("shard", "base"), "shard").select(
            "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
        )

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of one key's rows; empty for an unknown key.

        Reads a few numbers of one index file and of one shard by their place, whatever the size of
        the files: no Spark job, and nothing whole.
        """
        bucket = _bucket_of(doc_id, self.buckets)
        with _opened(self.folder, index_name(bucket)) as index:
            place = _place_in(index, doc_id)
        if place is None:
            return []
        number, row, copies = place
        with _opened(self.folder, shard_name(number)) as shard:
            return _rows_in(shard, row, copies)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None, folder: str | None = None
) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) and write shards and index.

    Rows are range partitioned by doc_id and sorted by doc_id, then text; a null id comes first.
    A null text is an empty one: its row holds the end id only. Rows that repeat a doc_id are all
    stored, next to each other, and the index gives them together. ``shards`` defaults to the
    session's shuffle partitions, fewer where the data is small. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "token-ids")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    entries = durable(
        ordered.sortWithinPartitions("doc_id", "text").mapInArrow(
            _write_shards(tokenizer_path, folder, end_id), _ENTRY
        ),
        "token-entries",
    )
    sums = entries.groupBy("shard").agg(F.sum("copies").alias("docs"), F.sum("ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = durable(
        sums.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("shard", "base", "docs", "ids"),
        "token-shards",
    )
    buckets = max(1, -(-entries.count() // KEYS_PER_INDEX))
    files = TokenFiles(folder, manifest, buckets)
    built = (
        entries.withColumn("bucket", files.bucket())
        .groupBy("bucket")
        .applyInArrow(_build_indexes(folder), "bucket int, keys bigint")
    )
    durable(built, "token-index")
    return files


def token_rows(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` as token files and give doc_id, start, n_tokens, ids_crc32 read back from them."""
    return write_token_files(docs, tokenizer_path).rows(docs)
