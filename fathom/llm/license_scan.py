"""License notices found by MinHash bands over overlapping windows, verified by exact containment.

Words are compared in lower case without punctuation. Every window of six words, one every two
words, gets a MinHash signature: word hashes moved by a whole number of bits give a new order for
each signature row. Two rows make a band. Templates are cut into windows at every word, so any
run of seven or more template words holds a window that equals one of the template's. A template
of five or six words may fill no document window whole, so its shingles are looked up at every
word. A window with the key of a
template's band makes the pair a candidate; then the share of the template's five-word shingles
in the document is counted exactly.

Only SQL functions are used. Documents are read once and not moved; what leaves the scan are the
candidates' shingles. Template keys are a fixed set of a few thousand numbers in the plan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
LEAST_CONTAINED = 0.8
WINDOW_WORDS = 6
STRIDE = 2
BANDS = 5
ROWS = 2
# Bits by which word hashes move from one signature row to the next.
MOVE = 5

# Wording of common license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:"
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def collision_probability(likeness: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two windows of this Jaccard likeness share a band."""
    return 1 - (1 - likeness**rows) ** bands


# Words of a text in lower case, without punctuation.
WORDS = r"filter(split(lower(coalesce(text, '')), r'[^\p{L}\p{N}]+'), w -> w != '')"


def _let(name: str, value: str, body: str) -> str:
    """SQL for the expression ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _band_keys(words: str, stride: int) -> str:
    """SQL for the array of band keys of all windows of the word array ``words``.

    The last window ends with the text; a text of fewer words than a window is one window.
    """
    last = f"greatest(0, size(words) - {WINDOW_WORDS})"
    starts = f"concat(sequence(0, {last}, {stride}), array({last}))"
    # Elements are read by place: slice() would copy the whole array for every window.
    held = [f"get(hashes, i + {j})" for j in range(WINDOW_WORDS)]
    rows = [
        "least(" + ", ".join(f"shiftleft({h}, {MOVE * n})" for h in held) + ")" for n in range(BANDS * ROWS)
    ]
    bands = ", ".join(
        f"xxhash64({b}, " + ", ".join(rows[b * ROWS : (b + 1) * ROWS]) + ")" for b in range(BANDS)
    )
    keys = f"flatten(transform({starts}, i -> array({bands})))"
    return _let("words", words, _let("hashes", "transform(words, w -> xxhash64(w))", keys))


def _shingles(words: str) -> str:
    """SQL for the distinct five-word shingles of the word array; none for fewer words."""
    each = "concat_ws(' ', " + ", ".join(f"words[i + {j}]" for j in range(SHINGLE_WORDS)) + ")"
    starts = f"if(size(words) < {SHINGLE_WORDS}, array(), sequence(0, size(words) - {SHINGLE_WORDS}))"
    return f"array_distinct({_let('words', words, f'transform({starts}, i -> {each})')})"


def _short_keys(words: str, starts: str) -> str:
    """SQL for the keys of the five-word shingles that begin at ``starts``."""
    each = ", ".join(f"get(words, i + {j})" for j in range(SHINGLE_WORDS))
    return _let("words", words, f"transform({starts}, i -> xxhash64({each}))")


def template_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """(license, keys, first, shingles) of the templates that have five words or more.

    ``first`` are the words that begin a shingle of a template no longer than a window, else none.
    """
    starts = f"sequence(0, size(words) - {SHINGLE_WORDS})"
    short = f"size(words) BETWEEN {SHINGLE_WORDS} AND {WINDOW_WORDS}"
    added = f"if({short}, {_short_keys('words', starts)}, array())"
    first = f"if({short}, slice(words, 1, greatest(0, size(words) - {SHINGLE_WORDS - 1})), array())"
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    return rows.select(
        "license",
        F.expr(f"array_distinct(concat({_band_keys(WORDS, 1)}, {_let('words', WORDS, added)}))").alias("keys"),
        F.expr(_let("words", WORDS, first)).alias("first"),
        F.expr(_shingles(WORDS)).alias("shingles"),
    ).filter("size(shingles) > 0")


def license_matches(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_CONTAINED
) -> DataFrame:
    """(doc_id, license, shingles, found, containment) for every document that holds a template.

    ``found`` of the template's ``shingles`` five-word shingles are in the document, at least the
    share ``least``. Documents without a match have no row; null, empty and wordless texts never
    match, nor do templates of fewer than five words. Each row that repeats a document gives its
    own matches; null ids are kept as null. Columns besides doc_id and text are not read.
    ``templates`` is a small set that the caller states; it becomes part of the plan.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates).collect()
    kinds = "doc_id bigint, license string, shingles int, found int, containment double"
    if not table:
        return spark.createDataFrame([], kinds)
    number = lambda k: f"{k}L"
    listed = ", ".join(map(number, sorted({k for row in table for k in row["keys"]})))
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    keys = _band_keys("ws", STRIDE)
    first = ", ".join(map(quoted, sorted({w for row in table for w in row["first"]})))
    if first:
        starts = f"filter(sequence(0, size(words)), i -> get(words, i) IN ({first}))"
        keys = f"concat({keys}, {_short_keys('ws', starts)})"
    hits = f"filter({_let('ws', WORDS, keys)}, k -> k IN ({listed}))"
    # One expression from text to counts, so that nothing of it is computed twice and shingles are
    # made for documents with a hit only.
    counts = ", ".join(
        "if(arrays_overlap(hits, array({keys})), named_struct('license', {name}, 'shingles', {size}, 'found', "
        "size(array_intersect(array({wanted}), held))), null)".format(
            keys=", ".join(map(number, row["keys"])),
            name=quoted(row["license"]),
            size=len(row["shingles"]),
            wanted=", ".join(map(quoted, row["shingles"])),
        )
        for row in table
    )
    verified = _let("held", _shingles(WORDS), f"array_compact(array({counts}))")
    found = _let("hits", hits, f"if(size(hits) = 0, null, {verified})")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(F.expr(found)).alias("m"))
    return (
        rows.select("doc_id", "m.license", "m.shingles", "m.found")
        .withColumn("containment", F.col("found") / F.col("shingles"))
        .filter(F.col("containment") >= least)
    )


def oracle_sql(templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_CONTAINED) -> str:
    """The same rows by counting every template's shingles in every document."""
    values = ", ".join(
        "('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in sorted(templates.items())
    )
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w != '')"
    shingles = "list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))"
    return f"""
WITH templates(license, text) AS (VALUES {values}),
wanted AS (
  SELECT license, {shingles} AS s
  FROM (SELECT license, {words.format('text')} AS w FROM templates)),
pieces AS (SELECT license, len(s)::INTEGER AS shingles, unnest(s) AS shingle FROM wanted),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
held AS (SELECT r, doc_id, unnest({shingles}) AS shingle FROM texts),
found AS (
  SELECT any_value(doc_id) AS doc_id, license, any_value(shingles) AS shingles, count(*)::INTEGER AS found
  FROM held JOIN pieces USING (shingle) GROUP BY r, license)
SELECT doc_id, license, shingles, found, found::DOUBLE / shingles AS containment
FROM found WHERE found::DOUBLE / shingles >= {least}
"""
