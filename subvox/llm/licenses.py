"""Licence scans: normalised text against templates by the Dice coefficient of word bigrams.

DataFrame functions only. The units of a text are its lines, its paragraphs, the whole of it, and for each template the
runs of words that may match it, wherever lines and paragraphs end; a unit and a template are lower case words of letters
and digits. A run of coefficient ``t`` has ``2 * |both| - t * |run| >= t * |template|``, so runs are the stretches with
the largest such sum, found in one pass over short chunks of words; they are then measured exactly. A unit has
its best template only. Two size bounds prune: a unit whose number of distinct bigrams lies
outside ``[t / (2 - t), (2 - t) / t]`` times a template's can't reach a coefficient of ``t`` with it, and a text
without at least ``t / (2 - t)`` of a template's bigrams holds no such unit or run: units and runs are compared with the
other templates only, and a text without any isn't cut. If the templates are few, a text without
any of their rarest bigrams' words is left out first (a match lacks at most a fixed part of the template's
bigrams, so that of one more than that many at least one must occur).
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Public notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and'
        " limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the"
        " Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission"
        " notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
        " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT"
        " HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
        " appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
        " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

# Full texts, as they are shipped.
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES.setdefault(_file.stem, []).append(_file.read_text(encoding="utf-8"))

#: Chunks of words per template, and distinct bigrams up to which templates are sought together.
CHUNKS, SHORT = 16, 400


def words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def compiled(templates: dict[str, list[str]], t: float) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """``name, bigrams`` of each template, and words of which every match holds at least one."""
    items = [(name, bigrams(x)) for name, texts in templates.items() for x in texts]
    items = [(name, b) for name, b in items if b]
    usual: dict[str, int] = {}
    for _, b in items:
        for w in {w for x in b for w in x.split()}:
            usual[w] = usual.get(w, 0) + 1
    keys = set()
    for _, b in items:
        # |A n T| >= t / 2 * (|A| + |T|) and |A| >= |T| t / (2 - t): a match lacks at most `spare` of the template's bigrams.
        spare = math.floor(len(b) - t / 2 * (len(b) * t / (2 - t) + len(b)) + 1e-9)
        rare = lambda w: (usual[w], -len(w), w)
        first = sorted(b, key=lambda x: min(rare(w) for w in x.split()))[: spare + 1]
        keys |= {min(x.split(), key=rare) for x in first}
    return items, sorted(keys)


def _pairs(unit: Column) -> Column:
    """Bigrams of a normalised unit (words with one blank between), in order."""
    # At the start of a word only, so that a text that is one long word is read once.
    return F.regexp_extract_all(unit, F.lit(r"\b(?=([a-z0-9]++ [a-z0-9]++))[a-z0-9]++"), F.lit(1))


def _bigrams(unit: Column) -> Column:
    """Distinct bigrams of a normalised unit."""
    return F.array_distinct(_pairs(unit))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", *, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``key, licenses, best_license, best_dice, n_matches``: one row per row of ``docs``.

    ``licenses``: names with a coefficient of at least ``threshold``, sorted, comma-joined; empty if none (then the best
    ones are null). Ties of the best go to the smaller name. ``n_matches``: matching lines, paragraphs and texts, and runs of
    words with another template or coefficient. Null and empty texts match nothing; no shuffle takes place.
    """
    items, keys = compiled(templates, threshold)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(b) for _, b in items]
    # The bigrams of a template are one literal: thousands of them would be slow to plan.
    struct = lambda i, name, b: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.split(F.lit("|".join(b)), "[|]").alias("grams"))
    numbered = [(i, name, b) for i, (name, b) in enumerate(items)]
    brief, bulky = ([x for x in numbered if (len(x[2]) <= SHORT) == side] for side in (True, False))
    few = F.split(F.lit("|".join(sorted({g for _, _, b in brief for g in b}))), "[|]")

    lower = F.lower(F.coalesce(F.col("_text"), F.lit("")))
    may = F.lit(len(keys) > 500)
    for k in keys if len(keys) <= 500 else []:
        may = may | F.contains(lower, F.lit(k))
    normal = lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    units = F.concat(F.split(lower, "\n"), F.when(F.contains(lower, F.lit("\n\n")), F.split(lower, "\n{2,}")).otherwise(F.array().cast("array<string>")))
    spaces = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))  # noqa: E731  bigrams, repeats counted
    some = lambda whole: F.filter(F.array_except(F.transform(units, normal), F.array(whole)), lambda u: spaces(u) >= F.lit(math.ceil(min(sizes) * low - 1e-9)))
    dice = lambda b, t: F.lit(2.0) * F.size(F.array_intersect(b, t["grams"])) / (F.size(b) + F.size(t["grams"]))
    fits = lambda b, t: (F.size(b) >= F.size(t["grams"]) * low - 1e-9) & (F.size(b) <= F.size(t["grams"]) * high + 1e-9)
    best_of = lambda ms: F.slice(F.array_sort(ms, lambda x, y: F.when(x["dice"] != y["dice"], F.when(x["dice"] > y["dice"], -1).otherwise(1)).when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(x["id"] - y["id"])), 1, 1)
    in_units = lambda whole, every, near: F.flatten(  # noqa: E731  whole: the normalised text, every: its distinct bigrams, near: templates it may hold
        F.transform(
            F.filter(F.concat(F.transform(some(whole), _bigrams), F.array(every)), lambda b: (F.size(b) >= min(sizes) * low - 1e-9) & (F.size(b) <= max(sizes) * high + 1e-9)),
            lambda b: best_of(
                F.filter(
                    F.transform(F.filter(near, lambda t: fits(b, t)), lambda t: F.struct(dice(b, t).alias("dice"), t["name"].alias("name"), t["id"].alias("id"))),
                    lambda m: m["dice"] >= threshold - 1e-12,
                )
            ),
        )
    )

    def bind(value: Column, use):
        """``use`` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def stretches(pairs: Column, t: Column) -> Column:
        """``first, last`` bigrams of the runs that may match ``t``."""
        size = F.size(t["grams"])
        step = F.greatest(F.lit(1), F.floor(size / CHUNKS).cast("int"))

        def add(state: Column, at: Column) -> Column:
            chunk = F.slice(pairs, at, step)
            return bind(
                F.lit(2.0) * F.size(F.array_intersect(chunk, t["grams"])) - F.lit(threshold) * F.size(F.array_distinct(chunk)),
                lambda gain: bind(
                    F.struct(
                        (F.greatest(state["sum"], F.lit(0.0)) + gain).alias("sum"),
                        F.when(state["sum"] > 0, state["first"]).otherwise(at).alias("first"),
                        F.when(state["sum"] > 0, state["peak"]).otherwise(F.lit(0.0)).alias("peak"),
                        F.when(state["sum"] > 0, state["last"]).otherwise(F.lit(0)).alias("last"),
                    ),
                    lambda now: bind(
                        F.struct(now["sum"].alias("sum"), now["first"].alias("first"), F.greatest(now["sum"], now["peak"]).alias("peak"), F.when(now["sum"] > now["peak"], at + step - 1).otherwise(now["last"]).alias("last")),
                        # No match spans a loss of more than 2 * (1 - threshold) of the template: it ends at the peak.
                        lambda now: F.when(
                            (now["sum"] <= 0) | (now["sum"] < now["peak"] - 2 * (1 - threshold) * size - step),
                            F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0.0).alias("peak"), F.lit(0).alias("last"), kept(state, now).alias("runs")),
                        ).otherwise(F.struct(now["sum"].alias("sum"), now["first"].alias("first"), now["peak"].alias("peak"), now["last"].alias("last"), state["runs"].alias("runs"))),
                    ),
                ),
            )

        def kept(state: Column, now: Column) -> Column:
            run = F.array(F.struct(now["first"].alias("first"), now["last"].alias("last")))
            return F.when(now["peak"] >= threshold * size / 2, F.concat(state["runs"], run)).otherwise(state["runs"])

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0.0).alias("peak"), F.lit(0).alias("last"), F.array().cast("array<struct<first:int,last:int>>").alias("runs"))
        return F.aggregate(F.sequence(F.lit(1), F.size(pairs), step), start, add, lambda end: kept(end, end))

    def runs(pairs: Column, t: Column) -> Column:
        measured = F.transform(
            stretches(pairs, t),
            lambda r: bind(F.array_distinct(F.slice(pairs, r["first"], r["last"] - r["first"] + 1)), lambda b: F.struct(dice(b, t).alias("dice"), t["name"].alias("name"), t["id"].alias("id"), r["first"].alias("first"), r["last"].alias("last"))),
        )
        return F.filter(measured, lambda m: m["dice"] >= threshold - 1e-12)

    def among(known: Column, group: list) -> Column:
        """Templates of ``group`` of which ``known`` has as many bigrams as a unit or run that matches must have."""
        near = F.filter(F.array(*[struct(*x) for x in group]), lambda t: F.size(known) >= F.size(t["grams"]) * low - 1e-6)
        return F.filter(near, lambda t: F.size(F.array_intersect(known, t["grams"])) >= F.size(t["grams"]) * low - 1e-6)

    def held(pairs: Column) -> Column:
        """Templates that a unit or run of the text may match."""
        parts = [bind(F.array_intersect(pairs, few), lambda known: among(known, brief))] if brief else []
        parts += [among(pairs, bulky)] if bulky else []
        return F.concat(*parts)

    def apart(ms: Column) -> Column:
        """Runs without those that overlap a better one."""
        better = lambda m, o: (o["first"] <= m["last"]) & (m["first"] <= o["last"]) & ((o["dice"] > m["dice"]) | ((o["dice"] == m["dice"]) & (o["id"] < m["id"])))
        left = F.filter(ms, lambda m: ~F.exists(ms, lambda o: better(m, o)))
        return F.transform(left, lambda m: F.struct(m["dice"].alias("dice"), m["name"].alias("name"), m["id"].alias("id")))

    def matches(whole: Column, pairs: Column, near: Column) -> Column:
        loose = bind(F.flatten(F.transform(near, lambda t: runs(pairs, t))), apart)
        return bind(bind(F.array_distinct(pairs), lambda every: in_units(whole, every, near)), lambda units: F.concat(units, F.array_except(loose, units)))

    # Most texts hold no template: these are neither cut into units nor searched for runs.
    found = bind(normal(lower), lambda whole: bind(_pairs(whole), lambda pairs: bind(held(pairs), lambda near: F.when((F.size(pairs) > 0) & (F.size(near) > 0), matches(whole, pairs, near)))))
    found = F.transform(found, lambda m: F.struct(m["dice"].alias("dice"), m["name"].alias("name")))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).select("_key", F.when(may, found).alias("_found"))
    rows = rows.withColumn("_found", F.coalesce("_found", F.array().cast("array<struct<dice:double,name:string>>")))
    best = F.array_max(F.transform("_found", lambda m: m["dice"]))
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["name"])))
    return rows.withColumn("_best", best).select(
        F.col("_key").alias(key),
        F.array_join(names, ",").alias("licenses"),
        F.array_min(F.transform(F.filter("_found", lambda m: m["dice"] == F.col("_best")), lambda m: m["name"])).alias("best_license"),
        F.round("_best", 6).alias("best_dice"),
        F.size("_found").cast("long").alias("n_matches"),
    )
