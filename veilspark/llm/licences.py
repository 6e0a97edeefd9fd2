"""License scans: phrases, and an exact set-similarity join of text blocks with license templates; DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import added, let, running
from veilspark.llm.common import parts_between, staged

#: Characters that are no part of a word, in either case; phrases and their labels.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NOT_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Licenses, and the notices and sentences by which licenses are named.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    "mpl-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at""",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "Released under the MIT License",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-work": "This work is licensed under the GNU General Public License",
    "cc-work": "This work is licensed under a Creative Commons Attribution International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "as-is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
}
#: Share of a template's different words that a block must hold.
CONTAINED = 0.8


def stride(size: int) -> int:
    """A text's blocks for a template of `size` words start at every stride-th word and have size + stride words, so every
    passage as long as the template lies whole in a block, wherever lines break."""
    return (size + 1) // 2


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(re.findall(NOT_GAP + "+", v.lower()))) for k, v in templates.items()}


def words_of(text: Column) -> Column:
    """Words in A-Z lower case, perhaps with empty strings at the ends. lower() agrees with that for the words of phrases and
    templates, which are ASCII, once the Kelvin sign is out, the one other letter whose lower case is ASCII."""
    return F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("?"))), GAP + "+", -1)


def count_words(text: Column) -> Column:
    return parts_between(text, GAP + "+")


def phrase_pattern(phrase: str) -> str:
    """The words of a phrase one after the other, whatever stands between, and whole."""
    return f"(?i)(?<!{NOT_GAP})" + (GAP + "+").join(phrase.split()) + f"(?!{NOT_GAP})"


def phrase_places(text: Column, phrase: str) -> Column:
    """Positions, in words from 0, at which a phrase starts."""
    pattern, width = phrase_pattern(phrase), len(phrase.split())

    def starts(counts: Column) -> Column:
        return F.zip_with(counts, running(F.transform(counts, lambda n: n + width), added), lambda n, before: before + n)

    counts = let(F.split(text, pattern, -1), lambda gaps: F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), count_words))
    return F.when(text.rlike(pattern), let(counts, starts)).otherwise(F.array().cast("array<bigint>"))


def token_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each template word, counted over all of them: as many rows as the templates have words."""
    held = F.array_intersect(words_of(F.col("text")), F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.filter("text is not null").select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


def ordered_templates(docs: DataFrame, templates: dict[str, str], least: float) -> list[tuple[str, list[str], int, int]]:
    """label, words by their frequency in the corpus (rare ones first), how many of them a block needs, and words in all."""
    words = template_words(templates)
    counts = token_frequencies(docs, sorted({w for ws in words.values() for w in ws}))
    out = []
    for k, ws in words.items():
        need = max(1, math.ceil(least * len(ws) - 1e-9))
        out.append((k, sorted(ws, key=lambda w: (counts.get(w, 0), w)), need, len(re.findall(NOT_GAP + "+", templates[k]))))
    return out


def template_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = CONTAINED) -> DataFrame:
    """row and matches (map of template to the best containment in a block) for docs (row, text) with a block that holds at
    least `least` of a template's words. Rows without one are left out; equal rows give one.

    Prefix filter: a block with need of a template's n words holds one of the first n - need + 1 of them, so texts meet
    templates by an equality join on those words, and only blocks around such a word are looked at. Positional filter: only
    under the first word of the prefix that a block holds, from which at least need words must be left. Length filter: a block
    has need words. What passes is verified on whole sets. The table of prefix words is as large as the templates, whatever
    the texts, so it is broadcast."""
    table = ordered_templates(docs, templates, least)
    prefix = [(w, k, i, ws, ws[: len(ws) - need + 1], need, size) for k, ws, need, size in table for i, w in enumerate(ws[: len(ws) - need + 1])]
    spark = docs.sparkSession
    tokens = spark.createDataFrame(prefix, "word string, label string, rank int, words array<string>, first array<string>, need int, size int")
    rare = F.array(*[F.lit(w) for w in sorted({x[0] for x in prefix})]).cast("array<string>")
    seq = docs.select("row", words_of(F.col("text")).alias("_w")).filter(F.arrays_overlap("_w", rare)).select("row", F.filter("_w", lambda w: w != "").alias("_w"))
    places = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(rare, x["word"]))
    near = seq.select("row", "_w", F.explode(places).alias("x")).select("row", "_w", "x.at", "x.word").join(F.broadcast(tokens), "word")
    near = near.filter(F.size("words") - F.col("rank") >= F.col("need")).withColumn("step", F.floor((F.col("size") + 1) / 2).cast("int"))
    oldest = F.greatest(F.floor((F.col("at") - F.col("size") - F.col("step")) / F.col("step")) + 1, F.lit(0)).cast("int")
    near = near.withColumn("b", F.explode(F.sequence(oldest, F.floor(F.col("at") / F.col("step")).cast("int"))))
    blocks = near.withColumn("block", F.slice("_w", F.col("b") * F.col("step") + 1, F.col("size") + F.col("step"))).drop("_w")
    blocks = blocks.filter((F.size("block") >= F.col("need")) & (F.get(F.array_intersect("first", "block"), F.lit(0)) == F.col("word")))
    held = blocks.withColumn("common", F.size(F.array_intersect("words", "block"))).filter("common >= need")
    best = held.groupBy("row", "label").agg(F.max(F.col("common") / F.size("words").cast("double")).alias("score"))
    return best.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("matches"))  # as many as templates


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches for each row of docs.

    base: places of the PHRASES. matches: template to the best containment in a block (see stride) where it is at least
    `least`; null for none. labels: base labels and names of matched templates. score: 1 with a base place, else the best
    containment, else 0. Null texts count as empty: no words, no labels, score 0. Repeated rows stay and fare alike. Very long
    texts take time in proportion. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text))).alias("row"), text.alias("text"))
    matched = staged(template_matches(docs, templates, least), "licenses")
    # The words are counted once a text; only texts with the last but one word of a phrase are looked into.
    holds = lambda words: F.arrays_overlap("_w", F.array(*[F.lit(w) for w in sorted(words)]))
    ends = (F.get("_w", F.lit(0)) == "").cast("long") + ((F.size("_w") > 1) & (F.get("_w", F.size("_w") - 1) == "")).cast("long")
    gated = docs.withColumn("_w", words_of(F.col("text"))).select("doc_id", "row", "text", (F.size("_w") - ends).cast("long").alias("n_words"), holds({p.split()[-2] for p in PHRASES}).alias("_maybe"))
    places = {phrase: f"_p{i}" for i, phrase in enumerate(PHRASES)}
    found = [F.when(F.col("_maybe"), phrase_places(F.col("text"), p)).otherwise(F.array().cast("array<bigint>")).alias(c) for p, c in places.items()]
    rows = gated.select("doc_id", "row", "n_words", *found)
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(PHRASES[p])) for p, c in places.items()])))
    rows = rows.select("doc_id", "row", "n_words", F.concat(*places.values()).alias("_all"), base.alias("_base")).join(matched, "row", "left")
    names = F.coalesce(F.map_keys("matches"), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.map_values("matches")), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size("_all").cast("long").alias("n_base"), F.array_min("_all").alias("first_word"), F.array_max("_all").alias("last_word"), F.array_join("_base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_base", names)), ",").alias("labels"), F.when(F.size("_all") > 0, F.lit(1.0)).otherwise(best).alias("score"), "matches")
