"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences (at ``. ! ? ; :`` before a blank, and at line
ends), each normalised (lower case, runs of other characters one blank) and
looked up among the known licence sentences. The known ones' identifiers, in
order, form a sequence; unknown sentences leave no mark, however many stand
between two known ones. Ordered rules then consume the sequence: a rule whose
identifiers stand next to each other in it gives its licence and takes all such
places, so a longer rule comes before those it contains. A place that was taken
stays between its neighbours: identifiers on its two sides are never next to
each other. Identifiers no rule took are reported as unmatched.

Sentences, rules and hints are tables that the caller may give; those below are
the default.

A sentence that goes over a line end is found as well: paragraphs are read a
second time with line ends as blanks, and the reading that knows more
sentences counts (on a tie the one that knows more characters, then the first).
A known sentence with an inner end (``v. 2.0``) is found as the whole sequence of
its parts, never by one part alone.

Edge cases: null and empty texts have no sentences; every row gives one row;
only doc_id and text are read. No shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, in the words of the public licence
# texts, with their identifiers.
SENTENCES = (
    ("MIT-ref", "Released under the MIT License."),
    ("MIT-ref", "This project is licensed under the MIT License"),
    ("MIT-ref", "Licensed under the MIT license"),
    ("MIT-title", "The MIT License (MIT)"),
    ("MIT-title", "MIT License"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
                  "this software and associated documentation files (the \"Software\"), to deal in "
                  "the Software without restriction, including without limitation the rights to "
                  "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
                  "of the Software, and to permit persons to whom the Software is furnished to do "
                  "so, subject to the following conditions"),
    ("MIT-notice", "The above copyright notice and this permission notice shall be included in all "
                   "copies or substantial portions of the Software."),
    ("MIT-asis", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
                 "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
                 "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("MIT-liable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
                   "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
                   "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
                   "OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2-ref", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2-ref", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2-comply", "you may not use this file except in compliance with the License."),
    ("Apache-2-obtain", "You may obtain a copy of the License at"),
    ("Apache-2-asis", "Unless required by applicable law or agreed to in writing, software "
                      "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                      "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2-see", "See the License for the specific language governing permissions and "
                     "limitations under the License."),
    ("GPL-3-ref", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3-ref", "Licensed under the GNU General Public License v3.0"),
    ("GPL-2-ref", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-free", "This program is free software"),
    ("GPL-2-later", "you can redistribute it and/or modify it under the terms of the GNU General "
                    "Public License as published by the Free Software Foundation; either version "
                    "2 of the License, or (at your option) any later version."),
    ("GPL-3-later", "you can redistribute it and/or modify it under the terms of the GNU General "
                    "Public License as published by the Free Software Foundation, either version "
                    "3 of the License, or (at your option) any later version."),
    ("GPL-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY "
                 "WARRANTY"),
    ("GPL-merchant", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
                     "PARTICULAR PURPOSE."),
    ("GPL-details", "See the GNU General Public License for more details."),
    ("LGPL-3-ref", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3-ref", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without "
                  "modification, are permitted provided that the following conditions are met"),
    ("BSD-source", "Redistributions of source code must retain the above copyright notice, this "
                   "list of conditions and the following disclaimer."),
    ("BSD-binary", "Redistributions in binary form must reproduce the above copyright notice, this "
                   "list of conditions and the following disclaimer in the documentation and/or "
                   "other materials provided with the distribution."),
    ("BSD-endorse", "Neither the name of the copyright holder nor the names of its contributors "
                    "may be used to endorse or promote products derived from this software without "
                    "specific prior written permission."),
    ("BSD-asis", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" "
                 "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
                 "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                 "DISCLAIMED."),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any "
                  "purpose with or without fee is hereby granted, provided that the above "
                  "copyright notice and this permission notice appear in all copies."),
    ("MPL-2-ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. "
                  "2.0."),
    ("CC-BY-4-ref", "Licensed under CC BY 4.0."),
    ("CC-BY-4-ref", "This work is licensed under a Creative Commons Attribution 4.0 International "
                    "License."),
    ("CC-BY-SA-4-ref", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4-ref", "Licensed under CC BY-NC 4.0."),
    ("CC0-ref", "Released under CC0 1.0 Universal."),
    ("Unlicense-ref", "This is free and unencumbered software released into the public domain."),
    ("All-rights", "All rights reserved."),
)

# Ordered rules, a licence and the identifiers that stand for it.
RULES = (
    ("MIT", ("MIT-grant", "MIT-notice", "MIT-asis", "MIT-liable")),
    ("MIT", ("MIT-grant", "MIT-notice", "MIT-asis")),
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-asis")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-asis")),
    ("GPL-2.0-or-later", ("GPL-free", "GPL-2-later", "GPL-hope", "GPL-merchant", "GPL-details")),
    ("GPL-2.0-or-later", ("GPL-free", "GPL-2-later")),
    ("GPL-3.0-or-later", ("GPL-free", "GPL-3-later", "GPL-hope", "GPL-merchant", "GPL-details")),
    ("GPL-3.0-or-later", ("GPL-free", "GPL-3-later")),
    ("Apache-2.0", ("Apache-2-ref", "Apache-2-comply", "Apache-2-obtain", "Apache-2-asis",
                    "Apache-2-see")),
    ("Apache-2.0", ("Apache-2-ref", "Apache-2-comply", "Apache-2-obtain")),
    ("Apache-2.0", ("Apache-2-ref",)),
    ("MIT", ("MIT-title", "MIT-ref")),
    ("MIT", ("MIT-ref",)),
    ("MIT", ("MIT-title",)),
    ("GPL-3.0", ("GPL-3-ref",)),
    ("GPL-2.0", ("GPL-2-ref",)),
    ("LGPL-3.0", ("LGPL-3-ref",)),
    ("AGPL-3.0", ("AGPL-3-ref",)),
    ("ISC", ("ISC-grant",)),
    ("MPL-2.0", ("MPL-2-ref",)),
    ("CC-BY-4.0", ("CC-BY-4-ref",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4-ref",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4-ref",)),
    ("CC0-1.0", ("CC0-ref",)),
    ("Unlicense", ("Unlicense-ref",)),
)

# Every known sentence has one of these words; texts without any are not cut.
HINTS = ("licen", "permission", "copyright", "warrant", "redistribut", "free software",
         "public domain", "rights reserved", "software", "cc0")

_ENDS = "(?<=[.!?;:])[ \\t]+|[\\r\\n]+"
_PARAGRAPHS = "\\n[ \\t\\r]*\\n"


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def sentence_keys(sentences=SENTENCES) -> dict[str, str]:
    """Normalised sentence -> identifier; a sentence with inner ends also as
    the sequence of its parts, with ``|`` between."""
    out: dict[str, str] = {}
    for name, sentence in sentences:
        parts = [p for p in (normalise(x) for x in re.split(_ENDS, sentence)) if p]
        out.setdefault(normalise(sentence), name)
        out.setdefault("|".join(parts), name)
    return out


def sequences(keys: dict[str, str]) -> tuple[list[int], list[str]]:
    """How many parts sentences with inner ends have, and their first parts."""
    several = [k.split("|") for k in keys if "|" in k]
    return sorted({len(parts) for parts in several}), sorted({parts[0] for parts in several})


def _normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _matches(pieces: Column, order: int, keys: dict[str, str]) -> Column:
    """What a reading's pieces know: (number, characters, order, ids)."""
    known = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    sizes, firsts = sequences(keys)

    def at(p: Column, s: Column, i: Column) -> Column:
        key = s
        for size in sizes:
            several = F.array_join(F.slice(p, i + 1, size), "|")
            key = F.when(F.element_at(known, several).isNotNull(), several).otherwise(key)
        key = F.when(s.isin(firsts), key).otherwise(s)
        return F.struct(F.element_at(known, key).alias("id"), F.length(key).alias("n"))

    def found(p: Column) -> Column:
        return F.filter(F.transform(p, lambda s, i: at(p, s, i)), lambda x: x["id"].isNotNull())

    def measured(x: Column) -> Column:
        return F.struct(F.size(x).alias("number"),
                        F.aggregate(x, F.lit(0), lambda n, y: n + y["n"]).alias("characters"),
                        F.lit(order).alias("order"),
                        F.transform(x, lambda y: y["id"]).alias("ids"))

    # one-element arrays, so that pieces and matches are worked out once
    cut = F.filter(F.transform(pieces, _normalised), lambda x: x != "")
    return F.transform(F.transform(F.array(cut), found), measured)[0]


def identifiers(text: Column, sentences=SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    keys = sentence_keys(sentences)
    joined = F.regexp_replace(F.regexp_replace(text, _PARAGRAPHS, ". "), "[\\r\\n]+", " ")
    return F.greatest(_matches(F.split(text, _ENDS), 1, keys),
                      _matches(F.split(joined, _ENDS), 0, keys))["ids"]


def apply_rules(sequence: Column, rules=RULES) -> Column:
    """(rest, found): what the ordered rules leave of ``|a||b|`` sequences, with
    ``#`` where places were taken, and the licences they give, in rule order."""
    table = F.array(*[F.struct(F.lit(name).alias("licence"),
                               F.lit("|" + "||".join(ids) + "|").alias("ids"))
                      for name, ids in rules])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        hit = F.contains(acc["rest"], rule["ids"])
        return F.struct(F.when(hit, F.replace(acc["rest"], rule["ids"], F.lit("#")))
                        .otherwise(acc["rest"]).alias("rest"),
                        F.when(hit, F.concat(acc["found"], F.array(rule["licence"])))
                        .otherwise(acc["found"]).alias("found"))

    return F.aggregate(table, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES,
         rules=RULES, hints=HINTS) -> DataFrame:
    """``sentences`` are (identifier, sentence), ``rules`` (licence, identifiers);
    texts without any of ``hints`` are not cut (none given: all are). Per row: doc_id, n_known (known sentences), sentence_ids (joined by
    commas, in order), licences (in rule order), unmatched (identifiers no rule
    took) and has_licence."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hinted = F.lower(text).rlike("|".join(map(re.escape, hints))) if hints else F.lit(True)
    ids = F.when(hinted, identifiers(text, sentences)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), ids.alias("_ids"))
    sequence = F.array_join(F.transform("_ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "")
    ruled = rows.withColumn("_ruled", apply_rules(sequence, rules))
    rest = F.regexp_replace(F.trim(F.col("_ruled.rest"), F.lit("|#")), "[|#]+", ",")
    return ruled.select(
        "doc_id", F.size("_ids").cast("bigint").alias("n_known"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("_ruled.found"), ",").alias("licences"),
        rest.alias("unmatched"), (F.size("_ruled.found") > 0).alias("has_licence"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same as DuckDB SQL. Its regular expressions have no look-behind, so
    an end is marked first and split at the mark."""
    pairs = sentence_keys()
    sizes, firsts = sequences(pairs)
    known = ("MAP([" + ", ".join(map(_sql, pairs)) + "], ["
             + ", ".join(map(_sql, pairs.values())) + "])")

    def pieces(text: str) -> str:
        marked = (f"regexp_replace(regexp_replace({text}, '([.!?;:])[ \\t]+', '\\1' || chr(1), 'g'),"
                  " '[\\r\\n]+', chr(1), 'g')")
        norm = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), ' ')"
        return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {norm}), "
                "lambda s: s <> '')")

    def keys(p: str) -> str:
        several = " ".join(
            f"WHEN s IN ({', '.join(map(_sql, firsts))}) AND {known}[{part}] IS NOT NULL THEN {part}"
            for part in (f"array_to_string({p}[i:i + {n - 1}], '|')" for n in reversed(sizes)))
        key = f"CASE {several} ELSE s END" if sizes else "s"
        return (f"list_filter(list_transform({p}, lambda s, i: {key}), "
                f"lambda k: {known}[k] IS NOT NULL)")

    def measure(k: str) -> str:
        return f"(len({k}), coalesce(list_sum(list_transform({k}, lambda x: length(x))), 0))"

    joined = ("regexp_replace(regexp_replace(t, '\\n[ \\t\\r]*\\n', '. ', 'g'), "
              "'[\\r\\n]+', ' ', 'g')")
    steps, last = [], "s0"
    for k, (name, names) in enumerate(RULES, 1):
        pattern = _sql("|" + "||".join(names) + "|")
        steps.append(f"r{k} AS (SELECT * REPLACE (replace(rest, {pattern}, '#') AS rest, "
                     f"CASE WHEN contains(rest, {pattern}) THEN list_append(found, {_sql(name)}) "
                     f"ELSE found END AS found) FROM {last})")
        last = f"r{k}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, t, regexp_matches(lower(t), {_sql('|'.join(HINTS))}) AS hinted FROM d),
p AS (SELECT doc_id, CASE WHEN hinted THEN {pieces('t')} ELSE [] END AS p,
             CASE WHEN hinted THEN {pieces(joined)} ELSE [] END AS q FROM h),
i AS (SELECT doc_id, {keys('p')} AS a, {keys('q')} AS b FROM p),
c AS (SELECT doc_id, list_transform(CASE WHEN {measure('b')} > {measure('a')} THEN b ELSE a END,
                                    lambda k: {known}[k]) AS ids FROM i),
s0 AS (SELECT doc_id, ids,
              coalesce(array_to_string(list_transform(ids, lambda x: '|' || x || '|'), ''), '')
              AS rest, CAST([] AS VARCHAR[]) AS found FROM c),
{', '.join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known,
       coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '')
       AS licences,
       regexp_replace(trim(rest, '|#'), '[|#]+', ',', 'g') AS unmatched, len(found) > 0 AS has_licence
FROM {last}"""
