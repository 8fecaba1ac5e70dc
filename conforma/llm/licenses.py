"""Licence scans: normalised units of a text against licence templates, by the Dice coefficient over word bigrams.

Units are the lines of a text, the text as a whole, and runs of adjacent sentences (a line's end also ends a sentence), so
notices that wrap over lines or share a line with other text are found too. Only DataFrame functions are used. A unit is
compared only with templates whose size allows the wanted Dice value (2 min(a, b) / (a + b) bounds it); units without any
of the words that a match must have, and units too large for all templates, are dropped before any bigram is made. Runs
begin and end in sentences with a bigram of the template, and only where so many lie close enough for a match.

Whole texts of long licences (folder license_texts) are templates too. Words hardly tell such matches, but any of their units
shares t / (2 - t) of the template's bigrams, and so does its text: texts large enough are counted by hashed bigrams, and only
those with as many are looked at further. A run of a long template is the stretch of sentences with the largest sum of 2 c - t n
(c shared and n own bigrams, each counted where it first occurs): Dice is t or more where 2 c - t n is t times the template's size.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise, small

THRESHOLD = 0.8
#: Templates of more bigrams are long: their texts are found by counts of bigrams, their runs by sums over sentences.
RUN_BIGRAMS = 400
#: Ends a sentence within a line.
SENTENCE_GAP = r"(?<=[.!?;:])[ \t]+"

MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Public notices by which texts state their licence, and the whole text of short licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        MIT_TEXT,
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2-Clause": [BSD_CONDITIONS + BSD_DISCLAIMER],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        BSD_CONDITIONS + BSD_THIRD + BSD_DISCLAIMER,
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ISC_TEXT,
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# The whole texts of long licences, as published, one file each.
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
for _name, _file in FILES.items():
    TEMPLATES.setdefault(_name, []).append((Path(__file__).parent / "license_texts" / f"{_file}.txt").read_text(encoding="utf-8"))


def normalised(text: Column) -> Column:
    """Lower-case ASCII letters and digits, words parted by single spaces; every other run of characters is a gap."""
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def bigrams(norm: Column) -> Column:
    """Distinct adjacent word pairs; a unit of one word has that word alone; an empty unit has none."""
    words = F.split(norm, " ")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(norm == "", F.array().cast("array<string>")).when(F.size(words) == 1, words).otherwise(F.array_distinct(pairs))


def _named(templates: dict) -> list[tuple[str, str, str]]:
    """(license, template, text): templates are named by licence and place, or as given by a dict of names."""
    return [(name, *x) for name, texts in templates.items() for x in (texts.items() if isinstance(texts, dict) else ((f"{name}#{k}", t) for k, t in enumerate(texts)))]


def template_bigrams(spark, templates: dict) -> DataFrame:
    """(license, template, t_size, bigram): as many rows as the given templates have bigrams, however large the corpus is."""
    rows = [(name, template, text) for name, template, text in _named(templates)]
    table = spark.createDataFrame(rows, "license string, template string, t_text string").withColumn("_b", bigrams(normalised(F.col("t_text"))))
    return table.select("license", "template", F.size("_b").alias("t_size"), F.explode_outer("_b").alias("bigram"))


@lru_cache(maxsize=256)
def _template_pairs(text: str) -> frozenset[tuple[str, ...]]:
    """Word pairs of a template, as bigrams() makes them."""
    words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
    return frozenset(zip(words, words[1:])) or frozenset({(words[0],)})


def by_size(templates: dict[str, list[str]]) -> tuple[dict, dict]:
    """(short, long): templates by licence and name, parted by RUN_BIGRAMS."""
    out: tuple[dict, dict] = ({}, {})
    for name, template, text in _named(templates):
        out[len(_template_pairs(text)) > RUN_BIGRAMS].setdefault(name, {})[template] = text
    return out


def needed_words(templates: dict, threshold: float) -> list[str]:
    """Words of which every unit that matches some template has at least one.

    A match shares at least t / (2 - t) of the template's b pairs, so words are taken until fewer of each template's pairs
    have none of them: first the word that leads most templates nearer to that, long words before short ones.
    """
    open_ = [(pairs, len(pairs) * threshold / (2 - threshold)) for pairs in (_template_pairs(text) for *_, text in _named(templates))]
    found: list[str] = []
    while open_ := [(rest, need) for pairs, need in open_ if len(rest := {p for p in pairs if not any(v in w for v in found for w in p)}) >= need - 1e-9]:
        uses = Counter(w for rest, _ in open_ for w in {w for p in rest for w in p})
        found.append(max(uses, key=lambda w: (len(w) >= 6, w.isdigit(), uses[w], len(w), w)))
    # a word that holds another needs no look of its own
    return sorted(w for w in found if not any(v != w and v in w for v in found))


def _once(part: DataFrame, value: Column, name: str) -> DataFrame:
    # a generated column is made once; filters on a plain one would make it anew for each of their terms
    return part.select("*", F.explode(F.array(value)).alias(name))


def _has_word(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def _keyed(rows: DataFrame) -> DataFrame:
    """_d, _h (never null: of doc_id and text), doc_id and text."""
    return rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.xxhash64("text").alias("_h"), "doc_id", "text")


def _texts(docs: DataFrame, words: list[str]) -> DataFrame:
    """_keyed rows of the texts with any of words."""
    return _keyed(_once(documents(docs), F.lower("text"), "low").where(_has_word(F.col("low"), words)).drop("low"))


def long_texts(docs: DataFrame, templates: dict, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Stored (_keyed rows, and _d, _h, license, template, t_size) of the texts that share as many bigrams with a long template as a match must.

    Bigrams are counted by 64-bit hashes, whose collisions could only add texts. Texts too short for any template are left out.
    """
    table = template_bigrams(docs.sparkSession, templates)
    words = F.split("bigram", " ")
    hashed = table.select("license", "template", "t_size", F.xxhash64(F.get(words, 0), F.get(words, 1)).alias("g")).where("g IS NOT NULL")
    share = threshold / (2 - threshold)
    least = min(len(_template_pairs(text)) for *_, text in _named(templates)) * share
    # m pairs take m + 1 words, and these as many letters and gaps between
    rows = _keyed(documents(docs).where(F.octet_length("text") >= int(2 * least)))
    rows = _once(rows.select("_d", "_h", "text"), F.split(normalised(F.col("text")), " "), "w").drop("text").where(F.size("w") > least)
    pairs = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.xxhash64(a, b)))
    # equal texts of a doc_id would count twice: counts are of one of them
    met = rows.withColumn("row", F.monotonically_increasing_id()).select("_d", "_h", "row", F.explode(pairs).alias("g")).join(F.broadcast(hashed), "g")
    counts = met.groupBy("_d", "_h", "row", "license", "template", "t_size").agg(F.count("*").alias("c"))
    found = materialise(counts.where(F.col("c") >= F.col("t_size") * share - 1e-9).select("_d", "_h", "license", "template", "t_size").distinct(), "license-candidates")
    ids = found.select("_d", "_h").distinct()
    texts = _keyed(documents(docs)).join(small(ids, ids.count()), ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"])
    return materialise(texts, "license-texts"), found


def scan_units(base: DataFrame, templates: dict, threshold: float = THRESHOLD, words: list[str] | None = None) -> DataFrame:
    """(doc_id, _d, _h, unit, license, template, dice) of every unit and template with dice >= threshold; unit 0 is the whole text, 1.. its lines.

    base: _keyed rows, each _d, _h once. words: if given, every matching unit has one of them.
    """
    sizes = sorted({len(_template_pairs(text)) for *_, text in _named(templates)})

    # 2 min(a, b) / (a + b) >= t holds if a lies between b t / (2 - t) and b (2 - t) / t
    allowed = reduce(lambda a, b: a | b, [F.col("n").between(s * threshold / (2 - threshold) - 1e-9, s * (2 - threshold) / threshold + 1e-9) for s in sizes])
    rows = base.select("doc_id", "_d", "_h", F.posexplode(F.split("text", "\n")).alias("k", "t")).select("doc_id", "_d", "_h", (F.col("k") + 1).alias("unit"), "t")
    if words:
        rows = _once(rows, F.lower("t"), "low").where(_has_word(F.col("low"), words)).drop("low")
    # a text of one line is its own unit
    whole = base.where(F.instr("text", "\n") > 0).select("doc_id", "_d", "_h", F.lit(0).alias("unit"), F.col("text").alias("t"))
    units = _once(rows.unionByName(whole), normalised(F.col("t")), "w").drop("t").where(F.col("w") != "")
    # k different words make k - 1 different pairs at least, so long texts are dropped before their pairs are made
    units = units.where(F.size(F.array_distinct(F.split("w", " "))) - 1 <= max(sizes) * (2 - threshold) / threshold + 1e-9)
    units = _once(units, bigrams(F.col("w")), "_b").withColumn("n", F.size("_b")).where(allowed)
    table = F.broadcast(template_bigrams(base.sparkSession, templates))
    joined = units.select("doc_id", "_d", "_h", "unit", "n", F.explode("_b").alias("bigram")).join(table, "bigram")
    joined = joined.where(F.col("n").between(F.col("t_size") * threshold / (2 - threshold) - 1e-9, F.col("t_size") * (2 - threshold) / threshold + 1e-9))
    counted = joined.groupBy("doc_id", "_d", "_h", "unit", "n", "license", "template", "t_size").agg(F.count("*").alias("c"))
    dice = 2 * F.col("c") / (F.col("n") + F.col("t_size"))
    return counted.withColumn("dice", dice).where(F.col("dice") >= threshold).select("doc_id", "_d", "_h", "unit", "license", "template", "dice")


def sentence_pairs(base: DataFrame, hits: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id, _d, _h, pos, seg, part, to_part, bigram: word pairs of the lines that aren't in hits (stored rows of scan_units).

    seg: matching lines before; part, to_part: sentences of the pair's words, counted over the text's other lines; pos: place of the pair.
    """
    cuts = F.array_sort(F.concat(F.array(F.lit(0)), F.collect_set(F.when(F.col("unit") > 0, F.col("unit")))))
    known = hits.groupBy("_d", "_h").agg(cuts.alias("_cuts"))
    rows = base.join(known, ["_d", "_h"], "left").withColumn("_cuts", F.coalesce("_cuts", F.array(F.lit(0))))

    def rest(lines: Column) -> Column:
        # slices between the matching lines, so that a text's work grows with its lines alone
        def seg(k: Column) -> Column:
            some = F.slice(lines, F.get("_cuts", k) + 1, F.coalesce(F.get("_cuts", k + 1), F.size(lines) + 1) - F.get("_cuts", k) - 1)
            return F.transform(some, lambda t: F.struct(k.alias("seg"), t.alias("t")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size("_cuts") - 1), seg))

    left = _once(rows, F.get(F.transform(F.array(F.split("text", "\n")), rest), 0), "_rest")
    if words:
        left = left.where(F.exists("_rest", lambda x: _has_word(F.lower(x["t"]), words)))
    parts = F.flatten(F.transform("_rest", lambda x: F.transform(F.split(x["t"], SENTENCE_GAP), lambda t: F.struct(x["seg"].alias("seg"), normalised(t).alias("t")))))
    left = _once(left.drop("text"), F.filter(parts, lambda x: x["t"] != ""), "_parts")
    flat = F.flatten(F.transform("_parts", lambda x, i: F.transform(F.split(x["t"], " "), lambda w: F.struct(x["seg"].alias("seg"), i.alias("part"), w.alias("w")))))
    left = _once(left, flat, "_w").where(F.size("_w") > 1)
    pairs = F.zip_with(F.slice("_w", 1, F.size("_w") - 1), F.slice("_w", 2, F.size("_w") - 1), lambda a, b: F.struct(a["seg"].alias("seg"), b["seg"].alias("to_seg"), a["part"].alias("part"), b["part"].alias("to_part"), F.concat_ws(" ", a["w"], b["w"]).alias("bigram")))
    pairs = left.select("doc_id", "_d", "_h", F.posexplode(pairs).alias("pos", "x")).select("doc_id", "_d", "_h", "pos", "x.*")
    return pairs.where(F.col("seg") == F.col("to_seg")).drop("to_seg")


def short_runs(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """A stored table of doc_id, _d, _h, seg, license, template, t_size, i, j: runs of sentences i..j that may match a template of table.

    A run's shared bigrams lie within as many words as the largest unit allowed for its template has bigrams.
    """
    key = ["_d", "_h"]
    share, most = F.col("t_size") * (threshold / (2 - threshold)), F.col("t_size") * ((2 - threshold) / threshold) + 1e-9
    met = pairs.join(F.broadcast(table), "bigram")
    # sentences of a template by the place of their first and last shared pair; a sum of counts bounds the distinct pairs
    spots = met.groupBy("doc_id", *key, "seg", "license", "template", "t_size", "part").agg(F.count("*").alias("c"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("to_part").alias("to_part"))
    within = ["_d", "_h", "seg", "template"]
    # places in thousandths of the allowed length, rounded down
    place = F.floor(F.col("lo") * 1000 / most)
    ahead = Window.partitionBy(*within).orderBy(place).rangeBetween(0, 1001)
    upto = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*within).orderBy(place).rangeBetween(-1001, 0)
    spots = spots.select("*", F.sum("c").over(ahead).alias("_ahead"), F.sum("c").over(back).alias("_back"), F.sum("c").over(upto).alias("_upto"), F.floor(F.col("lo") / most).alias("_cell"))
    spots = materialise(spots.where((F.col("_ahead") >= share - 1e-9) | (F.col("_back") >= share - 1e-9)), "license-spots")
    first = spots.where(F.col("_ahead") >= share - 1e-9)
    first = first.select("doc_id", *within, "license", "t_size", F.col("part").alias("i"), F.col("lo").alias("_from"), (F.col("_upto") - F.col("c")).alias("_before"), F.explode(F.array("_cell", F.col("_cell") + 1)).alias("_cell"))
    # a pair may end in the next sentence, so a run may end there as well as in its last first word's sentence
    last = spots.where(F.col("_back") >= share - 1e-9).select(*within, "_cell", "lo", "_upto", "hi", "part", F.explode(F.array_distinct(F.array("part", "to_part"))).alias("j"))
    runs = first.join(last, [*within, "_cell"]).where((F.col("part") >= F.col("i")) & (F.col("j") >= F.col("i")) & (F.col("lo") - F.col("_from") <= most) & (F.col("_upto") - F.col("_before") >= share - 1e-9))
    return materialise(runs.select("doc_id", *key, "seg", "license", "template", "t_size", "i", "j").distinct(), "license-runs")


def long_runs(pairs: DataFrame, table: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """A stored table like that of short_runs, with the best stretch of sentences of each seg for each template in found (see long_texts)."""
    key = ["_d", "_h", "seg"]
    firsts = pairs.groupBy("doc_id", *key, "bigram").agg(F.min(F.struct("part", "to_part")).alias("f")).select("doc_id", *key, "bigram", "f.part")
    own = firsts.groupBy("doc_id", *key, "part").agg(F.count("*").alias("n")).join(found, ["_d", "_h"])
    shared = firsts.join(F.broadcast(table.select("template", "bigram")), "bigram").groupBy(*key, "template", "part").agg(F.count("*").alias("c"))
    rows = own.join(shared, [*key, "template", "part"], "left").withColumn("s", 2 * F.coalesce("c", F.lit(0)) - threshold * F.col("n"))
    upto = Window.partitionBy(*key, "template").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("s").over(upto)).withColumn("low", F.min(F.struct((F.col("sum") - F.col("s")).alias("before"), F.col("part").alias("i"))).over(upto))
    best = rows.groupBy("doc_id", *key, "license", "template", "t_size").agg(F.max(F.struct((F.col("sum") - F.col("low.before")).alias("gain"), (-F.col("part")).alias("j"), F.col("low.i").alias("i"))).alias("b"))
    return materialise(best.where(F.col("b.gain") > 0).select("doc_id", *key, "license", "template", "t_size", F.col("b.i").alias("i"), (-F.col("b.j")).alias("j")), "license-runs")


def measured_runs(runs: DataFrame, pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """doc_id, _d, _h, i, j, license, c, dice of the stored runs with dice >= threshold; pairs: see sentence_pairs."""
    key = ["_d", "_h"]
    ranges = runs.select(*key, "i", "j").distinct().select("*", F.explode(F.sequence("i", "j")).alias("part"))
    unit = pairs.select(*key, "part", "to_part", "bigram").join(ranges, [*key, "part"]).where(F.col("to_part") <= F.col("j")).select(*key, "i", "j", "bigram").distinct()
    size = Window.partitionBy(*key, "i", "j")
    shared = unit.withColumn("n", F.count("*").over(size)).join(F.broadcast(table.select("template", "bigram")), "bigram").groupBy(*key, "i", "j", "template").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    found = runs.join(shared, [*key, "i", "j", "template"]).withColumn("dice", 2 * F.col("c") / (F.col("n") + F.col("t_size"))).where(F.col("dice") >= threshold)
    return found.select("doc_id", *key, "i", "j", "license", "c", "dice")


def best_runs(found: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, _d, _h, unit, license, dice) of measured runs; unit is -1 - the run's first sentence.

    A text has no run of a licence that it matches as a whole. Of runs that overlap, one counts if none of them has a larger dice
    times shared bigrams.
    """
    key = ["_d", "_h"]
    found = found.join(hits.where("unit = 0").select(*key, "license").distinct(), [*key, "license"], "left_anti")
    found = materialise(found, "license-found")
    # the best run at each of its sentences
    order = F.struct((-F.col("dice") * F.col("c")).alias("s"), "i", "j", "license", (-F.col("dice")).alias("d"))
    best = found.select("doc_id", *key, "i", "j", order.alias("o"), F.explode_outer(F.sequence("i", "j")).alias("part")).groupBy("doc_id", *key, "part").agg(F.min("o").alias("o"))
    stay = best.groupBy("doc_id", *key, "o").agg(F.count("*").alias("k")).where(F.col("k") == F.col("o.j") - F.col("o.i") + 1)
    return stay.select("doc_id", *key, (-1 - F.col("o.i")).alias("unit"), F.col("o.license").alias("license"), (-F.col("o.d")).alias("dice"))


def scan_documents(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct doc_id: doc_id, n_matches (units that match a template: lines, the text, and runs apart from them), license (of the best match), dice.

    Ties of dice go to the licence first in the alphabet. Documents without a match, null and empty texts have 0, null, null.
    Rows with a null doc_id count as one document. Rows with equal doc_id and text are one; of different texts that share a
    doc_id the units add up. Other columns are ignored; an empty table gives an empty result.
    """
    short, long = by_size(templates or TEMPLATES)
    units, scans = [], []
    if short:
        words = needed_words(short, threshold)
        base = _texts(docs, words).dropDuplicates(["_d", "_h"])
        units.append(scan_units(base, short, threshold, words))
    if long:
        texts, candidates = long_texts(docs, long, threshold)
        units.append(scan_units(texts, long, threshold))
    hits = materialise(reduce(DataFrame.unionByName, units), "license-hits")
    if short:
        pairs, table = sentence_pairs(base, hits, words), template_bigrams(docs.sparkSession, short)
        scans.append(measured_runs(short_runs(pairs, table, threshold), pairs, table, threshold))
    if long:
        pairs, table = sentence_pairs(texts, hits), template_bigrams(docs.sparkSession, long)
        scans.append(measured_runs(long_runs(pairs, table, candidates, threshold), pairs, table, threshold))
    runs = best_runs(reduce(DataFrame.unionByName, scans), hits)
    hits = hits.select("doc_id", "_d", "_h", "unit", "license", "dice").unionByName(runs)
    best = hits.groupBy("doc_id").agg(F.countDistinct("_h", "unit").alias("n_matches"), F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("b"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    none = ids.select("doc_id", F.lit(0).cast("long").alias("n_matches"), F.lit(None).cast("struct<d:double,license:string>").alias("b"))
    merged = best.unionByName(none).groupBy("doc_id").agg(F.max("n_matches").alias("n_matches"), F.max("b").alias("b"))
    return merged.select("doc_id", "n_matches", F.col("b.license").alias("license"), F.round(-F.col("b.d"), 6).alias("dice"))
