"""Passages that repeat across documents, by content-defined chunks of a gear rolling hash.

A text is cut where the rolling hash of the 32 bytes before falls below a threshold; a cut that
follows another within a few bytes is left out. Cuts depend on nearby bytes only, so a passage is
cut the same way wherever it stands, and an insertion moves the cuts around itself only. Chunks
are compared by digest over all documents. Neighbours in a run of repeated chunks may each be
shared with another document, so a run proves nothing: sequences of its chunks are compared. From
each chunk on, the shortest sequence of more words than the least passage is one if another
document has it. A shared sequence of ``LEAST_RUN`` bytes outside of those may be part of a passage
that goes on beyond its whole chunks. It becomes an anchor: wherever it stands, every window of the
least number of words around it is hashed, and windows that several documents have confirm the
passage. Windows too poor in cuts to hold such a sequence are few and are all hashed.

Shuffles carry digests and document ids, combined on the map side. The texts are moved once, to
join the documents' candidate runs, and cut again there instead of carrying positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fathom.llm.common import grouped_texts, plain_names, ship
from fathom.llm.rolling import BASES, Powers, mixed, word_hashes
from fathom.sources.scratch import durable

# Words of the shortest passage that counts as repeated.
LEAST_WORDS = 50
# One position in this many is a cut, before close ones are left out.
CUT_RATE = 28
# A cut within this many bytes after another candidate is left out.
CLOSE = 8
# Runs of repeated chunks below this many bytes are chance repeats of a few words.
LEAST_RUN = 24
WINDOW = 32
# Letters of texts that are cut together.
CUT_CHARS = 1_000_000
# A window of words with at least this part of all windows is joined by broadcast.
HOT_WINDOWS = 1000
# From this many bytes on, cuts in a passage do not depend on what stands before it.
SETTLED = WINDOW + CLOSE


def gear_table() -> np.ndarray:
    """256 random 32-bit numbers from a fixed seed; zero for the byte that separates texts."""
    table = np.random.default_rng(20).integers(1, 1 << 32, 256, dtype=np.uint32)
    table[0] = 0
    return table


_GEAR = gear_table()


def cut_positions(raw: np.ndarray) -> np.ndarray:
    """Ascending positions p of ``raw`` where a chunk ends before byte p."""
    rolling = _GEAR[raw]
    step = 1
    while step < WINDOW:
        wider = rolling.copy()
        wider[step:] += rolling[:-step] << np.uint32(step)
        rolling, step = wider, step * 2
    below = rolling[:-1] < np.uint32((1 << 32) // CUT_RATE)
    below &= raw[:-1] != 0
    at = np.flatnonzero(below & ((raw[1:] & 0xC0) != 0x80)) + 1
    apart = np.ones(len(at), bool)
    apart[1:] = np.diff(at) > CLOSE
    return at[apart]


def chunk_bounds(texts: list[str]) -> tuple[bytes, list[np.ndarray]]:
    """All texts' bytes with separators, and for each text its chunk borders in them."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    gap = bytes(WINDOW)
    joined = gap + gap.join(encoded) + gap
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    starts = WINDOW + np.cumsum(sizes + WINDOW) - sizes - WINDOW
    cuts = cut_positions(np.frombuffer(joined, np.uint8))
    first, last = np.searchsorted(cuts, starts, "right"), np.searchsorted(cuts, starts + sizes, "left")
    return joined, [
        np.concatenate(([s], cuts[a:b], [s + n])) if n else np.array([s])
        for s, n, a, b in zip(starts.tolist(), sizes.tolist(), first.tolist(), last.tolist())
    ]


def _word_starts(raw: np.ndarray) -> np.ndarray:
    space = (raw == 0x20) | ((raw >= 9) & (raw <= 13)) | (raw == 0)
    starts = np.zeros(len(raw), bool)
    starts[1:] = ~space[1:] & space[:-1]
    return starts


def _word_ends(raw: np.ndarray) -> np.ndarray:
    """Ascending positions behind the last byte of each word."""
    return len(raw) - np.flatnonzero(_word_starts(raw[::-1]))[::-1]


_POWERS = [Powers(b) for b in BASES]


def window_digests(raw: np.ndarray, at: np.ndarray, least_words: int) -> np.ndarray:
    """Two 64-bit numbers (rows) for the windows of ``least_words`` words from the words ``at`` on.

    Words are hashed once and a window is a sum over its words, so white space plays no part and
    neighbouring windows share their work.
    """
    starts, ends = np.flatnonzero(_word_starts(raw)), _word_ends(raw)
    digests = np.empty((len(at), 2), np.int64)
    for which, powers in enumerate(_POWERS):
        words = word_hashes(raw, starts, ends, which, powers)
        digests[:, which] = mixed(powers.sums(words, at, at + least_words)).view(np.int64)
    return digests


def poor_windows(
    raw: np.ndarray, starts: np.ndarray, least_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders and first words of the windows of ``least_words`` words that hold no chunks of
    ``LEAST_RUN`` bytes for sure.

    ``starts`` are those of the texts in ``raw``. The answer depends on a window's bytes only.
    """
    first, stop, cuts = np.flatnonzero(_word_starts(raw)), _word_ends(raw), cut_positions(raw)
    n = max(0, len(first) - least_words + 1)
    p, q = first[:n], stop[least_words - 1 :][:n]
    inside = np.searchsorted(starts, p, "right") == np.searchsorted(starts, q, "left")
    p, q = p[inside], q[inside]
    low, high = np.searchsorted(cuts, p + SETTLED, "left"), np.searchsorted(cuts, q, "right") - 1
    held = np.append(cuts, 0)
    poor = (high < low) | (held[high] - held[low] < LEAST_RUN)
    return p[poor], q[poor], np.flatnonzero(inside)[poor]


def _chunk_rows(least_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut_texts(batch, least_words)

    return work


def _cut_texts(batch: pa.RecordBatch, least_words: int) -> Iterator[pa.RecordBatch]:
    """Rows of chunks, and rows of windows poor in cuts, which have no chunk number."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    if batch.num_rows:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        version = batch.column(1).to_numpy(zero_copy_only=False)
        for start, texts in grouped_texts(batch.column(2).to_pylist(), CUT_CHARS):
            joined, bounds = chunk_bounds(texts)
            counts = np.fromiter((len(b) - 1 for b in bounds), np.int64, len(bounds))
            values = np.fromiter(
                (digest(joined[p:q]) for b in bounds for p, q in zip(b[:-1].tolist(), b[1:].tolist())),
                np.uint64,
                counts.sum(),
            )
            number = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
            borders = np.concatenate([b[:-1] for b in bounds]), np.concatenate([b[1:] for b in bounds])
            begun = np.cumsum(_word_starts(np.frombuffer(joined, np.uint8)))
            words = begun[borders[1] - 1] - begun[borders[0] - 1]
            rows = slice(start, start + len(texts))
            nulls = pa.nulls(len(values), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids[rows], counts), pa.int64()),
                    pa.array(np.repeat(version[rows], counts), pa.int64()),
                    pa.array(number, pa.int32()),
                    pa.array(values.view(np.int64)),
                    pa.array(borders[1] - borders[0], pa.int32()),
                    pa.array(words, pa.int32()),
                    *[nulls] * 4,
                ],
                names=_CUT,
            )
            raw = np.frombuffer(joined, np.uint8)
            begins = np.fromiter((b[0] for b in bounds), np.int64, len(bounds))
            p, q, at = poor_windows(raw, begins, least_words)
            if not len(p):
                continue
            char = np.cumsum((raw & 0xC0) != 0x80)
            text = np.searchsorted(begins, p, "right") - 1
            digests = window_digests(raw, at, least_words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[rows][text], pa.int64()),
                    pa.array(version[rows][text], pa.int64()),
                    pa.nulls(len(p), pa.int32()),
                    pa.nulls(len(p), pa.int64()),
                    pa.nulls(len(p), pa.int32()),
                    pa.nulls(len(p), pa.int32()),
                    pa.array(char[p] - char[begins[text]]),
                    pa.array(char[q - 1] - char[begins[text]] + 1),
                    pa.array(np.ascontiguousarray(digests[:, 0])),
                    pa.array(np.ascontiguousarray(digests[:, 1])),
                ],
                names=_CUT,
            )


_CUT = ["doc_id", "version", "chunk", "digest", "size", "words", "start", "stop", "high", "low"]
_CUT_TYPES = (
    "doc_id bigint, version bigint, chunk int, digest bigint, size int, words int, "
    "start bigint, stop bigint, high bigint, low bigint"
)


def _sequences(least_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each chunk of a run, the shortest sequence of enough bytes, and that of enough words."""
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(2)
            ends = runs.offsets.to_numpy().astype(np.int64)
            # All runs of a batch lie one behind another.
            first, ends = ends[0], ends - ends[0]
            held = {
                n: runs.values.field(n).to_numpy(zero_copy_only=False)[first : first + ends[-1]].astype(np.int64)
                for n in ("chunk", "digest", "size", "words")
            }
            run = np.repeat(np.arange(len(runs)), np.diff(ends))
            raw = np.stack([held["digest"], held["size"]], axis=1).tobytes()
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for whole, column, least in ((False, "size", LEAST_RUN), (True, "words", least_words + 1)):
                total = np.concatenate(([0], np.cumsum(held[column])))
                stops = np.searchsorted(total, total[:-1] + least, "left")
                begins = np.flatnonzero(stops <= ends[1:][run])
                stops, of = stops[begins], run[begins]
                values = np.fromiter(
                    (digest(raw[16 * i : 16 * j]) for i, j in zip(begins.tolist(), stops.tolist())),
                    np.uint64,
                    len(begins),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[0][of], pa.int64()),
                        pa.array(ids[1][of], pa.int64()),
                        pa.array(held["chunk"][begins], pa.int32()),
                        pa.array(held["chunk"][stops - 1], pa.int32()),
                        pa.array(np.full(len(begins), whole)),
                        pa.array(values.view(np.int64)),
                    ],
                    names=["doc_id", "version", "from", "to", "whole", "digest"],
                )

    return work


def _examined(least_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut texts again; give shared passages of whole chunks as they are and windows around anchors."""
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marks = batch.column(3).to_pylist()
            for start, texts in grouped_texts(batch.column(2).to_pylist(), CUT_CHARS):
                rows = slice(start, start + len(texts))
                yield from _examine(ids[rows], versions[rows], texts, marks[rows], least_words)

    return work


_EXAMINED = ["doc_id", "version", "start", "stop", "earliest", "high", "low"]


def _examine(
    ids: np.ndarray, versions: np.ndarray, texts: list[str], marks: list[list[dict]], least_words: int
) -> Iterator[pa.RecordBatch]:
    """Passages (start, stop, earliest) and windows (start, stop, high, low) of a group of texts."""
    joined, bounds = chunk_bounds(texts)
    raw = np.frombuffer(joined, np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80)
    first, stop = np.flatnonzero(_word_starts(raw)), _word_ends(raw)
    begins = np.fromiter((b[0] for b in bounds), np.int64, len(bounds))
    # Words of each text: its windows don't run into the next one.
    words = np.append(np.searchsorted(first, begins), len(first))
    passages: list[tuple[int, int, int, int]] = []
    around = np.zeros(len(first) + 1, np.int64)
    for i, (own, border) in enumerate(zip(marks, bounds)):
        for mark in own:
            begin, end = int(border[mark["from"]]), int(border[mark["to"] + 1])
            if mark["earliest"] is not None:
                passages.append((i, begin, end, mark["earliest"]))
                continue
            # Whole words inside.
            a, b = int(np.searchsorted(first, begin)), int(np.searchsorted(stop, end, "right"))
            low = max(int(words[i]), max(a, b) - least_words)
            high = min(a, int(words[i + 1]) - least_words)
            if low <= high:
                around[low] += 1
                around[high + 1] -= 1
    if passages:
        of, begin, end, earliest = np.array(passages, np.int64).T
        yield _located(ids, versions, of, char[begin] - char[begins[of]], char[end - 1] - char[begins[of]] + 1, earliest)
    at = np.flatnonzero(np.cumsum(around[:-1]) > 0)
    if len(at):
        of = np.searchsorted(words, at, "right") - 1
        p, q = first[at], stop[at + least_words - 1]
        digests = window_digests(raw, at, least_words)
        yield _located(ids, versions, of, char[p] - char[begins[of]], char[q - 1] - char[begins[of]] + 1, None, digests)


def _located(ids, versions, of, start, stop, earliest=None, digests=None) -> pa.RecordBatch:
    none = pa.nulls(len(of), pa.int64())
    high, low = (none, none) if digests is None else (pa.array(np.ascontiguousarray(d)) for d in digests.T)
    columns = [pa.array(x) for x in (ids[of], versions[of], start, stop)]
    return pa.RecordBatch.from_arrays(
        [*columns, none if earliest is None else pa.array(earliest), high, low], names=_EXAMINED
    )


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, version, text of the rows that have an id; rows that share an id are its versions."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("version"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("doc_id IS NOT NULL")


def _cut(docs: DataFrame, least_words: int) -> DataFrame:
    ship(docs.sparkSession)
    return durable(_identified(docs).mapInArrow(_chunk_rows(least_words), _CUT_TYPES), "chunks")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, earliest) of what several documents have."""
    return (
        rows.groupBy(*keys)
        .agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
        .filter("earliest < latest")
        .select(*keys, "earliest")
    )


def _repeated(cut: DataFrame) -> DataFrame:
    """(digest, doc_id, version, chunk, size, words, earliest) of every chunk that several documents have."""
    chunks = cut.filter("chunk IS NOT NULL").select(*_CUT[:6])
    return chunks.join(_shared(chunks, "digest"), "digest").distinct()


def repeated_chunks(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(digest, doc_id, version, chunk, size, words, earliest) of every chunk that several documents have."""
    return _repeated(_cut(docs, least_words))


def _spans(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, version, start, stop, earliest): stretches of each text that other documents hold."""
    cut = _cut(docs, least_words)
    in_text = Window.partitionBy("doc_id", "version").orderBy("chunk")
    fresh = F.when(F.col("chunk") - F.lag("chunk").over(in_text) == 1, 0).otherwise(1)
    runs = (
        _repeated(cut)
        .withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(in_text))
        .groupBy("doc_id", "version", "run")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "digest", "size", "words"))).alias("chunks"))
        .filter(F.expr(f"aggregate(chunks, 0, (a, c) -> a + c.size) >= {LEAST_RUN}"))
        .select("doc_id", "version", "chunks")
    )
    kinds = "doc_id bigint, version bigint, `from` int, `to` int, whole boolean, digest bigint"
    sequences = durable(runs.mapInArrow(_sequences(least_words), kinds), "sequences")
    hits = sequences.join(_shared(sequences, "whole", "digest"), ["whole", "digest"])
    so_far = Window.partitionBy("doc_id", "version").orderBy("from").rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("whole"), F.col("to"))).over(so_far)
    hits = durable(hits.withColumn("open", F.coalesce(reach < F.col("to"), F.lit(True))), "shared-sequences")
    pieces = hits.filter("NOT whole")
    anchors = pieces.filter("open").select("digest").distinct()
    marks = (
        hits.filter("whole")
        .select("doc_id", "version", "from", "to", "earliest")
        .union(
            pieces.join(anchors, "digest").select(
                "doc_id", "version", "from", "to", F.lit(None).cast("bigint")
            )
        )
        .groupBy("doc_id", "version")
        .agg(F.sort_array(F.collect_list(F.struct("from", "to", "earliest"))).alias("marks"))
    )
    examined = (
        _identified(docs)
        .join(marks, ["doc_id", "version"])
        .select("doc_id", "version", "text", "marks")
        .mapInArrow(_examined(least_words), ", ".join(f"{n} bigint" for n in _EXAMINED))
    )
    examined = durable(examined, "examined")
    place = ["doc_id", "version", "start", "stop"]
    long_ = examined.filter("high IS NULL").select(*place, "earliest")
    windows = examined.filter("high IS NOT NULL").drop("earliest").union(
        cut.filter("high IS NOT NULL").select(*place, "high", "low")
    )
    return long_.union(_confirmed(windows).select(*place, "earliest"))


def _confirmed(windows: DataFrame) -> DataFrame:
    """Windows that several documents have, with the smallest of these ids.

    A window that very many texts hold would be one key of the join. Those that make up at least
    one in ``HOT_WINDOWS`` of all rows, no more than so many, are joined by broadcast instead.
    """
    shared = (
        windows.groupBy("high", "low")
        .agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.count(F.lit(1)).alias("n"))
        .filter("earliest < latest")
    )
    shared = durable(
        shared.select("high", "low", "earliest", (F.col("n") * HOT_WINDOWS >= windows.count()).alias("hot")),
        "shared-windows",
    )
    hot = shared.filter("hot").drop("hot")
    tried = windows.join(F.broadcast(hot), ["high", "low"], "left")
    cold = tried.filter("earliest IS NULL").drop("earliest").join(shared.filter("NOT hot").drop("hot"), ["high", "low"])
    return tried.filter("earliest IS NOT NULL").unionByName(cold)


def _merged(found: DataFrame, among: Column) -> DataFrame:
    """Spans of a text that meet as one: doc_id, version, start, stop, first_doc_id.

    ``among`` says which spans count.
    """
    in_text = Window.partitionBy("doc_id", "version").orderBy("start", "stop")
    reached = F.max("stop").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached >= F.col("start"), 0).otherwise(1)
    return (
        found.filter(among)
        .withColumn("fresh", fresh)
        .withColumn("passage", F.sum("fresh").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "version", "passage")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("earliest").alias("first_doc_id"))
        .drop("passage")
    )


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, stop, first_doc_id, removed) for every passage that repeats.

    A passage is a stretch of at least ``least_words`` words that another document has too, given
    as a range of code points; stretches that meet are one. ``first_doc_id`` is the smallest id
    that every part of it was found under, and the other documents' copies are ``removed``: what
    is removed stands whole in earlier documents.
    Documents without such a passage have no row. Null and empty texts hold none. Rows that share
    an id are versions of one document, each with passages of its own: what repeats only among them
    is not reported, and an exact repeat of a row adds nothing. Rows without an id cannot be named
    and are left out. Columns besides doc_id and text are not read.
    """
    return _merged(_spans(docs, least_words), F.lit(True)).select(
        "doc_id", "start", "stop", "first_doc_id", (F.col("first_doc_id") < F.col("doc_id")).alias("removed")
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
        texts = []
        for text, cut in zip(batch.column(at).to_pylist(), spans):
            if text is not None and cut:
                kept, end = [], 0
                for span in cut:
                    kept.append(text[end : max(end, span["start"])])
                    end = max(end, span["stop"])
                text = "".join([*kept, text[end:]])
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays(
            [c for c, n in zip(columns, names) if n != "_spans"], names=[n for n in names if n != "_spans"]
        )


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with each repeated passage left in its first document only; rows and columns stay.

    Of a passage that meets one first seen here, what earlier documents hold is cut. Each text of
    rows that share an id loses its own passages only.
    """
    columns = docs.columns
    docs = plain_names(docs, "doc_id", "text")
    cuts = (
        _merged(_spans(docs, least_words), F.col("earliest") < F.col("doc_id"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    )
    same = (F.col("doc_id").cast("bigint") == F.col("_id")) & (F.xxhash64("text") == F.col("_version"))
    joined = docs.join(cuts, same, "left").drop("_id", "_version")
    return joined.mapInArrow(_without, docs.schema).toDF(*columns)
