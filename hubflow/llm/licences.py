"""Licence scans: named phrases, and an exact set-similarity join with licence texts. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm.common import ascii_lower, cut, split_words, whole

#: ASCII letters and digits in lower case, and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence texts, their notices for files, and sentences that name a licence; a label may have several.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions
in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met"""),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("agpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU Affero General Public License for more details."""),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU General Public License for more details."""),
    ("gpl-notice", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl-notice", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("lgpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mit-grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""),
    ("mit-grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"""),
    ("mit-released", "Released under the MIT License"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions"""),
)
#: The names of Creative Commons licences by code, and identifiers of the SPDX list.
CREATIVE_COMMONS = {
    "by": "Attribution", "by-nc": "Attribution-NonCommercial", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nd": "Attribution-NoDerivatives", "by-sa": "Attribution-ShareAlike",
}
SPDX = ("AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES += tuple((f"cc-{code}", f"This work is licensed under a Creative Commons {name} 4.0 International License") for code, name in CREATIVE_COMMONS.items())
TEMPLATES += tuple((f"cc-{code}", f"Licensed under CC {code.upper()} 4.0") for code in CREATIVE_COMMONS)
TEMPLATES += tuple((f"spdx-{x.lower()}", f"SPDX-License-Identifier: {x}") for x in SPDX)

#: By label the phrases that tell a licence from its relatives, which share most of its words. A block must
#: hold all their word pairs that the template holds.
MARKS = {
    "agpl-3.0": ("gnu affero general", "version 3"), "agpl-notice": ("gnu affero general",), "apache-2.0": ("apache license", "version 2 0"),
    "bsd-2-clause": ("bsd 2 clause",), "bsd-3-clause": ("bsd 3 clause",), "cc-by": ("attribution international",),
    "gpl-2.0": ("gnu general", "version 2"), "gpl-3.0": ("gnu general", "version 3"), "gpl-notice": ("gnu general",),
    "lgpl-2.1": ("gnu lesser general", "version 2 1"), "lgpl-3.0": ("gnu lesser general", "version 3"), "lgpl-notice": ("gnu lesser general",),
    "mit-released": ("mit license",), "mpl-2.0": ("mozilla public license",),
}
for _code, _name in CREATIVE_COMMONS.items():
    MARKS[f"cc-{_code}"] = (*MARKS.get(f"cc-{_code}", ()), f"{_name} 4".lower().replace("-", " "), f"{_code} 4".replace("-", " "))
for _id in SPDX:
    MARKS[f"spdx-{_id.lower()}"] = (re.sub(r"[-.]", " ", f"identifier {_id.lower()}"),)

#: Least share of a template's word pairs that a block must hold; a block is at most 1 / CONTAINMENT times as long as the template.
CONTAINMENT = 0.8


#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(low: Column) -> Column:
    """Words of a text whose A-Z are in lower case."""
    return split_words(low, BETWEEN)


def phrase_places(words: str, phrases: Mapping[str, str]) -> Column:
    """Array of (start, label), one for each place where a phrase's words stand consecutively; ``words`` names an array column."""
    return F.concat(*[_places(F.col(words), phrase, label) for phrase, label in phrases.items()])


def _places(words: Column, phrase: str, label: str) -> Column:
    names = [f"w{k}" for k in range(phrase.count(" ") + 1)]
    # offset words side by side, so that no lambda looks back at the whole array
    n = F.greatest(F.size(words) - (len(names) - 1), F.lit(0))
    beside = F.arrays_zip(*[F.slice(words, F.lit(k + 1), n).alias(x) for k, x in enumerate(names)])
    hit = F.transform(beside, lambda r, i: F.when(F.concat_ws(" ", *[r[x] for x in names]) == phrase, F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))))
    return F.filter(hit, lambda x: x.isNotNull())


def least_shared(size: Column, threshold: float) -> Column:
    """Word pairs of a template of ``size`` pairs that a block must hold."""
    return F.greatest(F.lit(1), F.ceil(size * F.lit(threshold) - F.lit(1e-9))).cast("int")


def word_pairs(words: str) -> Column:
    """Array of (at, pair): each two neighbouring words as one token, and the place of the first; ``words`` names an array column."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    beside = F.arrays_zip(F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"))
    return F.transform(beside, lambda r, i: F.struct(i.alias("at"), F.concat_ws(" ", r["a"], r["b"]).alias("pair")))


def mark_pairs(label: str, marks: Mapping[str, Sequence[str]]) -> list[str]:
    """The word pairs of a label's marks."""
    return [f"{a} {b}" for phrase in marks.get(label, ()) for a, b in zip(phrase.split(), phrase.split()[1:])]


def template_sets(spark: SparkSession, templates: Sequence[tuple[str, str]], threshold: float, marks: Mapping[str, Sequence[str]] = MARKS) -> DataFrame:
    """Per template: t, label, words (distinct), pairs (distinct), marks (pairs that a block must hold), length (most words of a block), least (how many pairs)."""
    rows = spark.createDataFrame([(i, label, body, mark_pairs(label, marks)) for i, (label, body) in enumerate(templates)], "t int, label string, body string, marks array<string>")
    rows = rows.select("t", "label", "marks", words_of(ascii_lower(F.col("body"))).alias("all")).where(F.size("all") > 1)
    sets = rows.select("t", "label", "marks", F.array_distinct("all").alias("words"), F.array_distinct(F.transform(word_pairs("all"), lambda x: x["pair"])).alias("pairs"), F.floor(F.size("all") / F.lit(threshold) + F.lit(1e-9)).cast("int").alias("length"))
    return sets.withColumn("marks", F.array_intersect("marks", "pairs")).withColumn("least", least_shared(F.size("pairs"), threshold))


def template_index(sets: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row per prefix pair of each template: prefix_pair, t.

    Pairs are in one global order, by the documents that hold the rarer of the two words and so at most the pair, the
    rarest first. A block that holds ``least`` of the pairs holds one of the first size - least + 1, the template's prefix.
    """
    ranked = sets.select("t", "least", F.explode("pairs").alias("pair")).withColumn("word", F.explode(F.split("pair", " "))).join(frequencies, "word", "left")
    ranked = ranked.groupBy("t", "least", "pair").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    ordered = ranked.groupBy("t", "least").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("o"))
    return ordered.select("t", F.explode(F.slice("o.pair", F.lit(1), F.size("o") - F.col("least") + 1)).alias("prefix_pair"))


def similar_blocks(held: DataFrame, key: list[str], sets: DataFrame, frequencies: DataFrame, known: list[str]) -> DataFrame:
    """Every text and template of which one of its blocks holds at least ``least`` pairs: key, label, containment.

    A block is a run of consecutive words, whatever lies between them, of at most ``length`` words of the template. So
    wrapped text is found, and neither words strewn over a long line nor the same words in another order are.

    ``held``: key, low (a text in lower case). Texts are reduced to the pairs of templates (``known``) and their places,
    as no other pair can be shared. A text meets a template on a pair of the template's prefix (prefix filter) if it has
    ``least`` of its pairs in all (length filter) and its marks; then for each place the distinct pairs of the block that
    begins there are counted (positional filter: only places within the block's length are looked at), and a block
    without all marks counts for nothing. The template side is as large as the ``templates`` argument, whatever the
    corpus, so it is broadcast.
    """
    cut_up = held.select(*key, words_of(F.col("low")).alias("all_words"))
    placed = cut(cut_up.select(*key, F.filter(word_pairs("all_words"), lambda x: x["pair"].isin(known)).alias("hits")))
    # rows may share a key: equal texts share their results
    placed = placed.dropDuplicates(key)
    met = placed.select(*key, F.explode(F.array_distinct("hits.pair")).alias("prefix_pair")).join(F.broadcast(template_index(sets, frequencies)), "prefix_pair").select(*key, "t").distinct()
    p, m = placed.alias("p"), met.alias("m")
    both = p.join(m, F.expr(" AND ".join(f"p.{k} <=> m.{k}" for k in key))).select("p.*", "m.t").join(F.broadcast(sets.select("t", "label", "pairs", "marks", "least", "length")), "t")
    own = both.select(*key, "label", "pairs", "marks", "least", "length", F.filter("hits", lambda x: F.array_contains("pairs", x["pair"])).alias("own")).where((F.size(F.array_distinct("own.pair")) >= F.col("least")) & (F.size(F.array_except("marks", "own.pair")) == 0))
    # pairs stand at places of their own, so as many as a block has words are enough
    block = lambda x, i: F.filter(F.slice("own", i + 1, F.col("length")), lambda y: y["at"] < x["at"] + F.col("length") - 1)
    pairs = F.transform("own", lambda x, i: F.array_distinct(F.transform(block(x, i), lambda y: y["pair"])))
    most = F.coalesce(F.array_max(F.transform(F.filter(pairs, lambda b: F.size(F.array_except("marks", b)) == 0), F.size)), F.lit(0))
    shared = own.select(*key, "label", F.size("pairs").alias("size"), most.alias("shared"), "least")
    return shared.where("shared >= least").select(*key, "label", (F.col("shared") / F.col("size")).alias("containment"))


def scan_licences(docs: DataFrame, *, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, marks: Mapping[str, Sequence[str]] = MARKS, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels are those of phrases whose words stand consecutively; places are counted for each phrase, and
    first_word and last_word are their smallest and largest start. ``labels`` adds those of templates of which a
    block (a run of words at most 1 / ``threshold`` times as long as the template, line feeds or not) holds at least
    ``threshold`` of the distinct word pairs and the ``marks`` of the label, which tell it from its relatives (the GPL from
    the LGPL and the AGPL, a version or a variant from the others). score: the largest such share, 1 where a phrase stands, else 0.

    The corpus is read and cut into words once: each text leaves its places, its words that occur in templates, and,
    only if it holds enough words of some template for one of its blocks to match, the text. Words are counted over the
    documents of the whole corpus, and that orders their pairs; the join then works on what was left.

    Nulls: a null text is empty; a null id stays null. No place gives null first_word and last_word, no label gives ''.
    Rows that repeat an id and a text share their results; other columns are ignored.
    """
    sets = template_sets(docs.sparkSession, templates, threshold, marks)
    rules = sets.collect()  # as large as the argument
    names = sorted({w for r in rules for w in r["words"]})
    known = F.array(*[F.lit(w) for w in names]).cast("array<string>")
    base = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("key"), ascii_lower(F.col("text")).alias("low"))
    cut_up = base.withColumn("words", words_of(F.col("low")))
    # every phrase has these words, so texts without one need no search
    common = set.intersection(*[set(p.split(" ")) for p in phrases]) if phrases else set()
    may = F.lit(bool(phrases))
    for w in sorted(common):
        may = may & F.contains("low", F.lit(w))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    own = cut_up.select("doc_id", "key", "low", F.size("words").cast("long").alias("n_words"), F.when(may, phrase_places("words", phrases) if phrases else none).otherwise(none).alias("places"), F.array_intersect("words", known).alias("set"))
    enough = F.lit(False)
    for r in rules:  # a missing pair costs a block one word at most
        enough = enough | (F.size(F.array_intersect(F.array(*[F.lit(w) for w in r["words"]]), F.col("set"))) >= len(r["words"]) - (len(r["pairs"]) - r["least"]))
    rows = cut(own.withColumn("low", F.when(enough, F.col("low"))))
    frequencies = cut(rows.select(F.explode("set").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    found = similar_blocks(rows.where("low IS NOT NULL").select("doc_id", "key", "low"), ["doc_id", "key"], sets, frequencies, sorted({x for r in rules for x in r["pairs"]}))
    r, d = rows.drop("low", "set").alias("r"), found.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most")).alias("d")
    rows = r.join(d, F.expr("r.doc_id <=> d.doc_id AND r.key = d.key"), "left").select("r.*", F.coalesce("d.more", F.array().cast("array<string>")).alias("more"), F.coalesce("d.most", F.lit(0.0)).alias("most"))
    starts, labels = F.col("places.start"), F.array_distinct(F.col("places.label"))
    n = F.size("places").cast("long")
    return rows.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.col("more"))), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.col("most")).alias("score"),
    )
