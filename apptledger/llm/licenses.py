"""Licence scans: passages compared with licence texts by the Dice coefficient of their word bigrams.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lowered; all else
separates. A passage is a line, a paragraph (lines up to an empty one) or the whole text. A passage and a template match when twice
the number of distinct bigrams they share is at least ``THRESHOLD`` of the sum of theirs.

Two bounds spare work and lose no match. A coefficient of t needs sizes within a factor of t / (2 - t), so
only templates of about a passage's size are compared. And a match shares at least t / (2 - t) of a
template's bigrams, so it holds one of any larger rest of them: each template names a few words that cover such a
rest, and a text without any of these words is passed over after one search.

All of it runs inside the row, in built-in expressions; the templates travel as constants, so their
number is bounded by ``MAX_TEMPLATES``. Null and empty texts, and texts of a single word, match nothing.
Texts are taken whole. Ties go to the longer passage, then to the template's name. Repeated rows give repeated
results, an empty table an empty one; existing columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATES = 500

# Short notices and paragraphs of public licences, as their texts read.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "Apache-2.0 disclaimer": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."),
    "MIT notice": "Released under the MIT License.",
    "MIT notice licensed": "Licensed under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"),
    "MIT condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."),
    "MIT warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "BSD grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"),
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "GPL warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details."),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0 notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All rights reserved": "All rights reserved.",
    "CC BY 4.0": "Licensed under CC BY 4.0.",
    "CC BY-SA 4.0": "Licensed under CC BY-SA 4.0.",
    "CC BY-ND 4.0": "Licensed under CC BY-ND 4.0.",
    "CC BY-NC 4.0": "Licensed under CC BY-NC 4.0.",
    "CC BY-NC-SA 4.0": "Licensed under CC BY-NC-SA 4.0.",
}

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Words of ordinary prose, taken as probes last.
COMMON = frozenset((
    "a all an and any are as at be by do for from if in is it may no not of on or other otherwise out persons possible "
    "so subject that the their these this to under was whether which who will with without you your").split())
#: Shorter probes must stand as a word of their own, as parts of words hold them too often.
PROBE_PART = 6
MATCHES = "array<struct<dice:double,n_bigrams:int,license:string,passage:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a template; ``words`` is the same rule as a column."""
    return [w.translate(str.maketrans(UPPER, LOWER)) for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)]


def bigrams_of(text: str) -> list[str]:
    """Distinct neighbours, in order."""
    found = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(found, found[1:], strict=False)))


def probe_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every match of a template holds at least one.

    For each template, words are taken until the bigrams without any of them are too few for a match. Words that
    ordinary prose seldom holds come first: none of ``COMMON``, and longer ones, by what they add.
    """
    share = threshold / (2 - threshold)
    chosen: Counter[str] = Counter()
    for text in templates.values():
        open_pairs = [tuple(b.split(" ")) for b in bigrams_of(text)]
        least = share * len(open_pairs)

        def covered(pairs):
            return [p for p in pairs if not (p[0] in chosen or p[1] in chosen)]

        open_pairs = covered(open_pairs)
        while open_pairs and len(open_pairs) >= least:
            gains = Counter(w for pair in open_pairs for w in set(pair))
            chosen[max(gains, key=lambda w: (w not in COMMON, not w.isdigit(), min(len(w), 7), gains[w], w))] += 1
            open_pairs = covered(open_pairs)
    return sorted(chosen)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def bigrams(found: Column) -> Column:
    """Distinct bigrams of an array of words; empty for fewer than two."""
    return F.when(F.size(found) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.zip_with(
        F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(1))), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(1))),
        lambda a, b: F.concat_ws(" ", a, b))))


def passages(text: Column) -> Column:
    """Lines, paragraphs and the whole text; equal passages once."""
    return F.array_distinct(F.concat(
        F.split(text, "\n"), F.split(text, r"\n[\x20\t\r]*\n"), F.array(text)))


def matches(text: Column, templates: dict[str, str], threshold: float) -> Column:
    """Every (passage, template) with its coefficient, as structs."""
    listed = F.array(*[
        F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, bigrams_of(body))).alias("bigrams"))
        for name, body in sorted(templates.items()) if bigrams_of(body)])
    sizes = [len(b) for body in templates.values() if (b := bigrams_of(body))]
    share = threshold / (2 - threshold)
    least, most = share * min(sizes), max(sizes) / share
    counted = F.transform(passages(text), lambda p: F.struct(p.alias("passage"), bigrams(words(p)).alias("bigrams")))
    counted = F.filter(counted, lambda p: F.size(p["bigrams"]).between(least, most))

    def compare(passage: Column) -> Column:
        size = F.size(passage["bigrams"])
        near = F.filter(listed, lambda t: (size >= share * F.size(t["bigrams"])) & (size * share <= F.size(t["bigrams"])))
        return F.transform(near, lambda t: F.struct(
            (2 * F.size(F.array_intersect(passage["bigrams"], t["bigrams"])) / (size + F.size(t["bigrams"]))).alias("dice"),
            size.alias("n_bigrams"), t["license"].alias("license"), passage["passage"].alias("passage")))

    return F.filter(F.flatten(F.transform(counted, compare)), lambda m: m["dice"] >= threshold)


def scan(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``matches`` (dice, n_bigrams, license, passage), the best one first."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    none = F.array().cast(MATCHES)
    if not any(bigrams_of(body) for body in templates.values()):
        return df.withColumn("matches", none)
    # Looked for as plain strings, so a word that holds another needs no search of its own.
    probes = probe_words(templates, threshold)
    probes = [w for w in probes if not any(v != w and v in w and len(v) >= PROBE_PART for v in probes)]
    found = F.array_sort(matches(df[text], templates, threshold), lambda a, b: (
        F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1)
        .when(a["n_bigrams"] > b["n_bigrams"], -1).when(a["n_bigrams"] < b["n_bigrams"], 1)
        .when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0)))
    lowered = df.withColumn("__lower__", F.lower(df[text]))
    inside = "0-9A-Za-z\\x{80}-\\x{10FFFF}"

    def holds(probe: str) -> Column:
        part = F.contains(F.col("__lower__"), F.lit(probe))
        return part if len(probe) >= PROBE_PART else part & F.col("__lower__").rlike(f"(?<![{inside}]){probe}(?![{inside}])")

    any_probe = reduce(or_, map(holds, probes))
    return lowered.withColumn("matches", F.when(any_probe, found.cast(MATCHES)).otherwise(none)).drop("__lower__")
