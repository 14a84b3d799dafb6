"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, long ones in pieces of ``PIECE_WORDS`` words; its first
``OPENING_WORDS`` words are a piece of their own, so that short texts have more than one. Every digest goes
into three of a sketch's cells, which hold a count, the exclusive or of their digests and that of
the digests' checks. Cells of two versions subtract: what both have cancels out. A cell left with
a single digest gives it away; taken out of its other cells it may free more, until the sketch is
empty and all differing digests are known. If that fails, the sketch was too small: digests are
dealt to as many small sketches as their number asks for. Those of a small sketch that fails too are
dealt to four and then sixteen times as many; all others keep what they found.

Only SQL functions are used. Texts are moved once, to meet their next document in order of ids;
all the rest is work within a row. Cells are arrays, and peeling is a fold over a few rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.sources.scratch import durable

# Words of a paragraph's piece, and of the piece that opens a text.
PIECE_WORDS = 16
OPENING_WORDS = 8
# Cells of each of the three parts of a sketch.
WIDTH = 5
PARTS = 3
ROUNDS = 6
# Digests of both versions for each small sketch, and growth from one retry to the next.
LOAD = 8
GROWTH = (1, 4, 16)
# Pairs with more digests than this are dealt out in two steps.
LARGE = 512
# Ranges of ids for each shuffle partition.
RANGES = 2


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: str) -> str:
    """SQL for the distinct paragraph digests of a text column."""
    words = r"(?:[^ \n]+ ?)"
    pattern = rf"\A{words}{{1,{OPENING_WORDS}}}|{words}{{1,{PIECE_WORDS}}}"
    pieces = f"regexp_extract_all(coalesce({text}, ''), r'{pattern}', 0)"
    return f"array_distinct(transform({pieces}, p -> xxhash64(p)))"


def _check(d: str) -> str:
    return f"(xxhash64({d}) & 4294967295)"


def _place(d: str, part: int) -> str:
    """Cell of a digest within a part, from bits of its own."""
    return f"((shiftrightunsigned({d}, {13 * part}) & 8191) % {WIDTH})"


def prepared(values: str) -> str:
    """SQL for an array of digests with what is asked of each again and again: its check, its cells
    and the bits that deal it to small sketches."""
    places = ", ".join(f"'p{j}', cast({_place('d', j)} as int)" for j in range(PARTS))
    bits = "'s', cast(shiftrightunsigned(d, 39) & 8191 as int), 'g', cast(shiftrightunsigned(d, 52) as int)"
    return f"transform({values}, d -> named_struct('d', d, 'x', {_check('d')}, {places}, {bits}))"


def sketch(entries: str) -> str:
    """SQL for the cells (c, k, x) of an array of prepared digests."""
    zero = "named_struct('c', 0, 'k', 0L, 'x', 0L)"
    add = "(a, e) -> named_struct('c', a.c + 1, 'k', a.k ^ e.d, 'x', a.x ^ e.x)"
    cells = (
        f"aggregate(filter({entries}, e -> e.p{part} = {cell}), {zero}, {add})"
        for part in range(PARTS)
        for cell in range(WIDTH)
    )
    return f"array({', '.join(cells)})"


def subtracted(mine: str, other: str) -> str:
    cell = "named_struct('c', p.c - q.c, 'k', p.k ^ q.k, 'x', p.x ^ q.x)"
    return f"zip_with({mine}, {other}, (p, q) -> {cell})"


def _difference(mine: str, other: str) -> str:
    """SQL for the cells of two arrays of prepared digests, one subtracted from the other."""
    zero = "named_struct('c', 0, 'k', 0L, 'x', 0L)"
    add = "(a, e) -> named_struct('c', a.c + 1, 'k', a.k ^ e.d, 'x', a.x ^ e.x)"
    take = "(a, e) -> named_struct('c', a.c - 1, 'k', a.k ^ e.d, 'x', a.x ^ e.x)"
    cells = []
    for part in range(PARTS):
        for cell in range(WIDTH):
            a, b = (f"filter({side}, e -> e.p{part} = {cell})" for side in (mine, other))
            cells.append(f"aggregate({b}, aggregate({a}, {zero}, {add}), {take})")
    return f"array({', '.join(cells)})"


def peeled(cells: str, keep: bool = False) -> str:
    """SQL for the number of digests that peeling recovers, -1 if some stay hidden.

    With ``keep`` it is the digests themselves as (c, k), c being 1 for a digest of the first
    version and -1 for one of the second; null if some stay hidden.
    """
    places = ", ".join(f"'p{j}', cast({_place('c.k', j)} + {j * WIDTH} as int)" for j in range(PARTS))
    alone = f"filter(s.cells, c -> abs(c.c) = 1 AND c.x = {_check('c.k')})"
    pure = f"array_distinct(transform({alone}, c -> named_struct('c', c.c, 'k', c.k, 'x', c.x, {places})))"
    hit = " OR ".join(f"p.p{j} = i" for j in range(PARTS))
    less = "(a, p) -> named_struct('c', a.c - p.c, 'k', a.k ^ p.k, 'x', a.x ^ p.x)"
    rest = f"transform(s.cells, (c, i) -> aggregate(filter(pure, p -> {hit}), c, {less}))"
    more = "concat(s.n, transform(pure, p -> named_struct('c', p.c, 'k', p.k)))" if keep else "s.n + size(pure)"
    # A round without a digest is the last one that looks for any.
    stop = "named_struct('cells', s.cells, 'n', s.n, 'more', false)"
    step = _let("pure", pure, f"if(size(pure) = 0, {stop}, named_struct('cells', {rest}, 'n', {more}, 'more', true))")
    none = f"cast(array() AS {_FOUND})" if keep else "0"
    empty = "forall(s.cells, c -> c.c = 0 AND c.k = 0 AND c.x = 0)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'n', {none}, 'more', true), "
        f"(s, r) -> if(s.more, {step}, s), s -> if({empty}, s.n, {'NULL' if keep else '-1'}))"
    )


_FOUND = "array<struct<c: int, k: bigint>>"


def _power_of_two(number: str) -> str:
    return f"cast(pow(2, ceil(log2(greatest(1.0D, {number})))) as int)"


def _counted(mine: str, other: str, keep: bool) -> str:
    """SQL for what ``peeled`` gives, from the prepared digests themselves."""
    sides = ((mine, other, 1), (other, mine, -1))
    alone = [(f"filter({a}, e -> NOT exists({b}, f -> f.d = e.d))", c) for a, b, c in sides]
    if keep:
        told = [f"transform({a}, e -> named_struct('c', {c}, 'k', e.d))" for a, c in alone]
        return f"concat({', '.join(told)})"
    return " + ".join(f"size({a})" for a, _ in alone)


def _total(found: str, keep: bool) -> str:
    return f"flatten({found})" if keep else f"aggregate({found}, 0, (a, y) -> a + y)"


# What deals a digest in each retry: bits that neither its cells nor another retry depend on.
_DEALS = ("e.s", "cast(shiftright(e.x, 8) & 4095 as int)", "cast(shiftright(e.x, 20) as int)")


def _retried(mine: str, other: str, growth: str, keep: bool, level: int) -> str:
    """SQL for the differing digests from small sketches, the ones that fail being dealt again; what
    the smallest ones hide is counted on their digests."""
    if level == len(_DEALS):
        return _counted(mine, other, keep)
    n, t, u, v = (f"{name}{level}" for name in "ntuv")
    deal = f"{_DEALS[level]} % {n} = {t}"
    again = _retried(f"{u}.a", f"{u}.b", str(GROWTH[min(level + 1, len(GROWTH) - 1)]), keep, level + 1)
    one = _let(v, peeled(_difference(f"{u}.a", f"{u}.b"), keep), f"if({v} {'IS NOT NULL' if keep else '>= 0'}, {v}, {again})")
    one = _let(u, f"named_struct('a', filter({mine}, e -> {deal}), 'b', filter({other}, e -> {deal}))", one)
    wanted = f"least(8192, {growth} * {_power_of_two(f'(size({mine}) + size({other})) / {LOAD}.0D')})"
    return _let(n, wanted, _total(f"transform(sequence(0, {n} - 1), {t} -> {one})", keep))


def _dealt(mine: str, other: str, growth: str, keep: bool = False) -> str:
    """SQL for the number of differing digests that many small sketches find; with ``keep`` for the
    digests."""
    large = f"size({mine}) + size({other})"
    parts = f"if({large} < {LARGE}, 1, least(4096, {_power_of_two(f'sqrt({large})')}))"
    part = "e.g % m = g"
    sides = (f"if(m = 1, {side}, filter({side}, e -> {part}))" for side in (mine, other))
    each = _let("w", "named_struct('a', {}, 'b', {})".format(*sides), _retried("w.a", "w.b", growth, keep, 0))
    return _let("m", parts, _total(f"transform(sequence(0, m - 1), g -> {each})", keep))


def differing(mine: str, other: str, cells: str, other_cells: str) -> str:
    """SQL for the number of digests that only one of two versions has.

    The sketches' difference is peeled; small ones follow where that fails.
    """
    first = peeled(subtracted(cells, other_cells))
    return _let("whole", first, f"if(whole >= 0, whole, {_dealt(mine, other, str(GROWTH[0]))})")


def recovered(mine: str, other: str, cells: str, other_cells: str) -> str:
    """SQL for the digests that only one of two versions has, as (c, k) like in ``peeled``."""
    first = peeled(subtracted(cells, other_cells), True)
    return _let("whole", first, f"if(whole IS NOT NULL, whole, {_dealt(mine, other, str(GROWTH[0]), True)})")


def changed_paragraphs(df: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with ``removed`` and ``added``: ascending digests of the paragraphs that only the text
    column ``old`` or only ``new`` has, recovered from the difference of their sketches.

    Null texts are empty; both arrays are empty for texts with the same paragraphs. Other columns
    pass, but for former ones of these names.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("removed", "added")]
    held = df.select(F.struct(*kept).alias("_row"), *(F.expr(prepared(digests(f"`{c}`"))).alias(n) for n, c in (("pa", old), ("pb", new))))
    held = held.withColumns({"sa": F.expr(sketch("pa")), "sb": F.expr(sketch("pb"))})
    sides = (
        F.array_sort(F.expr(f"transform(filter(_changes, e -> e.c = {c}), e -> e.k)")).alias(name)
        for name, c in (("removed", 1), ("added", -1))
    )
    names = [c for c in df.columns if c not in ("removed", "added")]
    whole = held.select("_row", F.expr(recovered("pa", "pb", "sa", "sb")).alias("_changes"))
    return whole.select(*(F.col("_row")[c].alias(c) for c in names), *sides)


def _as_text(cells: str) -> str:
    cell = "concat(lower(hex(c.c)), '.', lower(hex(c.k)), '.', lower(hex(c.x)))"
    return f"array_join(transform({cells}, c -> {cell}), '-')"


def _likeness(total: str, differ: str) -> Column:
    """Shared digests as a share of all: 1 for two texts without a paragraph."""
    return F.expr(f"if({total} = 0, 1.0D, ({total} - {differ}) / ({total} + {differ}))").cast("double")


def _range_number(bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are not above the id, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    array = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    middle = "shiftright(s.lo + s.hi, 1)"
    step = (
        f"if(s.lo >= s.hi, s, if(get({array}, {middle}) <= doc_id, "
        f"named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle})))"
    )
    return F.expr(
        f"aggregate(sequence(1, {len(bounds).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(bounds)}), "
        f"(s, r) -> {step}, s -> s.lo)"
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, paragraphs, next_text, next_paragraphs), the last row's next being the first.

    Rows are ordered by id, null first, then text. They are dealt to ranges of ids, and a copy of
    the first row of every range stands at the end of the range before, so that each row finds
    its next one in its own range. The ids' quantiles, a fixed number of them, go to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / count for i in range(1, count)]
    ids = rows.select("doc_id")
    found = ids.agg(F.percentile_approx("doc_id", cuts, 10 * count).alias("q")).first()["q"] if cuts else None
    number = _range_number(sorted(set(found or [])))
    firsts = (
        ids.groupBy(number.alias("range"))
        .agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
        .orderBy("range")
        .collect()
    )
    before = [(firsts[i]["first"], firsts[i - 1]["range"]) for i in range(len(firsts))]
    if firsts and firsts[0]["nulls"]:
        before[0] = (None, firsts[-1]["range"])
    edge = spark.createDataFrame(before, "edge bigint, range int")
    copies = (
        rows.join(F.broadcast(edge), F.col("doc_id").eqNullSafe(F.col("edge")))
        .groupBy("doc_id", "range")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", "range", F.lit(1).alias("copy"))
    )
    dealt = rows.withColumns({"range": number, "copy": F.lit(0)}).unionByName(copies).repartition("range")
    dealt = dealt.withColumn("paragraphs", F.expr(digests("text")))
    in_order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return (
        dealt.withColumns(
            {
                "next_text": F.lead("text").over(in_order),
                "next_paragraphs": F.lead("paragraphs").over(in_order),
            }
        )
        .filter("copy = 0")
        .drop("copy", "range")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points, rounded down, replaced by as many first
    ones of the next document, or all it has. Likeness is the share of paragraph digests that two
    versions have in common, from the differing digests that peeling recovers. A null text counts
    as empty; two texts without paragraphs are alike. Rows that repeat an id follow one another in
    order of their texts. A single row is its own next. Columns besides doc_id and text are not
    read. An empty table gives no rows.
    """
    chars = F.char_length("text")
    cut = F.floor(chars / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), chars - cut), F.substring(F.col("next_text"), F.lit(1), cut)
    )
    versions = with_next(docs).select(
        "doc_id", chars.cast("bigint").alias("n_chars"), edited.alias("edited"), "paragraphs", "next_paragraphs"
    )
    versions = durable(
        versions.select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            F.col("paragraphs").alias("a"),
            F.expr(digests("edited")).alias("b"),
            F.col("next_paragraphs").alias("c"),
        ),
        "versions",
    )
    # A step of its own for each, so that none is written out again in the next.
    held = versions.withColumns({f"p{c}": F.expr(prepared(c)) for c in "abc"})
    held = held.withColumns({f"s{c}": F.expr(sketch(f"p{c}")) for c in "abc"})
    held = held.withColumns({"edits": F.expr(differing("pa", "pb", "sa", "sb")), "others": F.expr(differing("pa", "pc", "sa", "sc"))})
    return held.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(_as_text("sa")).alias("fingerprint"),
        F.expr(_as_text("sb")).alias("edited_fingerprint"),
        _likeness("(size(a) + size(b))", "edits").alias("near_edited"),
        _likeness("(size(a) + size(c))", "others").alias("near_next"),
    )
