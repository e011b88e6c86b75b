"""License scans: exact phrases, and an exact set-similarity join of license texts with text blocks.

Short names of licenses are phrases: their words must stand consecutively. Whole license texts and notices are templates
of the set join. A block is a window of words; a template is compared with blocks of its own size class: the least power
of two, 64 at least, of twice its words, and a new block begins every half of that, so a template that stands together
lies whole in some block, however long it is. A template labels a block that contains at least ``percent`` of its
distinct words. The join finds all such pairs: template words are ordered by their frequency in the whole corpus, rarest
first; a template that needs c of its m words can only match a block that holds one of its first m-c+1 (prefix
filter); the block must hold c words of templates of the class at all (length filter); and the places of the shared word
in both orders must leave room for c (positional filter). What is left is verified on the whole sets.

DataFrame and SQL functions only. Only documents with a prefix word are cut into blocks, and only template words make
rows, so a very long text costs in proportion to its words; one task splits it. Template tables have a fixed size and are
broadcast; no text does. Null, empty and wordless texts have no words and no labels. Lower case means A-Z. Repeated rows
get equal results; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns may have
any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.session import Scratch

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_WINDOW = 64
PERCENT = 80

# Phrases and labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Names in common use and their labels. Their words must stand consecutively, too.
NAMES = {
    "mit license": "mit",
    "attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "attribution sharealike": "cc-by-sa",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "all rights reserved": "all-rights-reserved",
}

# License texts and notices and their labels. Notices that differ in a few words only stand once: that of
# the GNU licenses is "gnu", and the name in the text says which of them it is.
TEMPLATES = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
    merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
    to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
    or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
    INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
    SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
    OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
    You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
    writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
    either express or implied. See the License for the specific language governing permissions and limitations under the License.""": "apache-2",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
    published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
    FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
    General Public License along with this program. If not, see https://www.gnu.org/licenses/.""": "gnu",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
    this file, You can obtain one at http://mozilla.org/MPL/2.0/.""": "mpl",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
    HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
    FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
    SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
    WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
    EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
    that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
    DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
    SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
    OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
    THE USE OR PERFORMANCE OF THIS SOFTWARE.""": "isc",
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
    damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
    commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
    software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
    an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly
    marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any
    source distribution.""": "zlib",
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
    and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
    copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
    detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
    and future rights to this software under copyright law.""": "unlicense",
    """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
    documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
    and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject
    to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
    restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
    works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
    a source language processor.""": "boost",
}


def template_words(template: str) -> list[str]:
    """The words of a template, as those of a text."""
    return [w for w in re.split(SEPARATORS, template.translate({c: c + 32 for c in range(65, 91)})) if w]


def window_of(template: str) -> int:
    """Words of the blocks that a template is compared with; a new one begins every half of that."""
    return max(LEAST_WINDOW, 1 << (2 * len(template_words(template)) - 1).bit_length())


def normalised(text: Column) -> Column:
    """The words of text, each with a space on either side; no words: two spaces. Only A-Z are lower-cased."""
    text = F.coalesce(text, F.lit(""))
    # two letters outside A-Z have a lower case that begins with an ASCII letter; there the slower, narrower way is taken
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    low = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, "  ")), F.lit(" "))


def word_count(words: Column) -> Column:
    return F.when(words == "  ", F.lit(0)).otherwise((F.length(words) - F.length(F.replace(words, F.lit("  "), F.lit("")))) / 2 + 1).cast("bigint")


def _gaps(s: Column) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit("  "), F.lit("")))) / 2).cast("bigint")


def spaced(phrase: str) -> str:
    return " " + "  ".join(phrase.split()) + " "


def phrase_places(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first start, last start) of a phrase's words standing consecutively; starts count words from 0."""
    p = spaced(phrase)
    has = F.contains(words, F.lit(p))
    n = F.when(has, F.regexp_count(words, F.lit(f"(?=\\Q{p}\\E)"))).otherwise(0)
    first = F.when(has, _gaps(F.substr(words, F.lit(1), F.instr(words, p))))
    behind = F.instr(F.reverse(words), p[::-1])  # characters of the end of words up to the last place, from 1
    last = F.when(has, word_count(words) - len(phrase.split()) - _gaps(F.substr(F.reverse(words), F.lit(1), behind)))
    return n, first, last


def vocabulary(templates: dict[str, str]) -> list[str]:
    return sorted({w for t in templates for w in template_words(t)})


def corpus_order(words: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """Rank of each template word by its count in all texts, rarest first (ties: by the word)."""
    vocab = vocabulary(templates)
    table = words.sparkSession.createDataFrame([(w,) for w in vocab], "w string")
    said = words.select(F.explode(F.split(F.trim("words"), "  ")).alias("w")).join(F.broadcast(table), "w").groupBy("w").count()
    n = {r["w"]: r["count"] for r in said.collect()}  # a row for each template word at most
    return {w: i for i, w in enumerate(sorted(vocab, key=lambda w: (n.get(w, 0), w)))}


def template_tables(templates: dict[str, str], rank: dict[str, int], percent: int = PERCENT) -> list[tuple]:
    """(window, label, ranks, needed, prefix rank, its place) for each prefix word of each template."""
    rows = []
    for text, label in templates.items():
        ranks = sorted({rank[w] for w in template_words(text)})
        need = -(-percent * len(ranks) // 100)
        rows += [(window_of(text), label, ranks, need, r, at) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    return rows


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, percent: int = PERCENT, names: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (greatest containment; 1 for a phrase or name)."""
    phrases, templates, names = phrases or PHRASES, templates or TEMPLATES, NAMES if names is None else names
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    words = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("words"))
    rank = corpus_order(words, templates)
    rows = template_tables(templates, rank, percent)
    rare = sorted({w for w, r in rank.items() if r in {x[4] for x in rows}})
    places = [phrase_places(F.col("words"), p) for p in phrases]
    base = [F.when(n > 0, F.lit(label)) for (n, _, _), label in zip(places, phrases.values(), strict=True)]
    called = [F.when(F.contains("words", F.lit(spaced(p))), F.lit(label)) for p, label in names.items()]
    some = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *c))))
    facts = scratch.keep(
        words.select(
            "doc_id", word_count(F.col("words")).alias("n_words"),
            sum((n for n, _, _ in places), F.lit(0)).cast("bigint").alias("n_base"),
            F.array_min(F.array(*(f for _, f, _ in places))).alias("first_word"),
            F.array_max(F.array(*(v for _, _, v in places))).alias("last_word"),
            some(base).alias("base"), some(called).alias("called"),
            F.when(F.rlike("words", F.lit(" (?:" + "|".join(rare) + ") ")), F.col("words")).alias("words"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "facts",
    )
    by_class = sorted({(w, rank[w], window_of(t)) for t in templates for w in template_words(t)})
    code = spark.createDataFrame(by_class, "w string, r int, size int")
    prefix = spark.createDataFrame(rows, "size int, label string, ranks array<int>, need int, r int, tpos int")
    # a word at place i is in the windows that start at the multiples of half a window from i-size+1 to i
    spoken = facts.where("words is not null").select("rid", F.posexplode(F.split(F.trim("words"), "  ")).alias("i", "w")).join(F.broadcast(code), "w")
    held = spoken.select("rid", "size", "r", F.explode(F.expr("sequence(greatest(0, cast(ceil((i - size + 1) / (size div 2)) as int)), cast(i div (size div 2) as int))")).alias("block"))
    blocks = held.groupBy("rid", "size", "block").agg(F.array_sort(F.collect_set("r")).alias("b"))
    candidates = blocks.select("rid", "size", "b", F.posexplode("b").alias("bpos", "r")).join(F.broadcast(prefix), ["size", "r"])
    room = F.expr("1 + least(size(ranks) - tpos - 1, size(b) - bpos - 1)")
    verified = (
        candidates.where((F.size("b") >= F.col("need")) & (room >= F.col("need")))
        .withColumn("same", F.size(F.array_intersect("b", "ranks"))).where("same >= need")
        .groupBy("rid").agg(F.collect_set("label").alias("found"), F.max(F.col("same") / F.size("ranks")).alias("best"))
    )
    none = F.array().cast("array<string>")
    labels = F.array_union(F.array_union("base", "called"), F.coalesce("found", none))
    return facts.drop("words").join(verified, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when((F.col("n_base") > 0) | (F.size("called") > 0), F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql() -> str:
    """The same result by brute force: every window of its class against every template, every place against every phrase and name."""
    listed = lambda table: ", ".join(f"({p.split()}, '{label}')" for p, label in table.items())
    template_rows = ", ".join(f"({sorted(set(template_words(t)))}, {window_of(t)}, '{label}')" for t, label in TEMPLATES.items())
    return f"""
WITH p(ws, label) AS (VALUES {listed(PHRASES)}), m(ws, label) AS (VALUES {listed(NAMES)}), t(ws, size, label) AS (VALUES {template_rows}),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
spots AS (SELECT rid, w, unnest(range(len(w))) AS i FROM d),
hits AS (SELECT rid, label, i FROM spots, p WHERE w[i + 1] = ws[1] AND w[i + 1 : i + len(ws)] = ws),
base AS (SELECT rid, count(*) AS n, min(i) AS f, max(i) AS l, list_sort(list(DISTINCT label)) AS labels FROM hits GROUP BY rid),
called AS (SELECT rid, list(DISTINCT label) AS labels FROM spots, m WHERE w[i + 1] = ws[1] AND w[i + 1 : i + len(ws)] = ws GROUP BY rid),
starts AS (SELECT rid, w, size, unnest(range((2 * len(w) + size - 1) // size)) * (size // 2) AS lo FROM d, (SELECT DISTINCT size FROM t)),
blocks AS (SELECT rid, size, list_distinct(w[lo + 1 : lo + size]) AS b FROM starts),
found AS (
  SELECT rid, max(same / len(ws)) AS best, list(DISTINCT label) AS labels
  FROM (SELECT rid, ws, label, len(list_intersect(b, ws)) AS same FROM blocks JOIN t USING (size)) WHERE 100 * same >= {PERCENT} * len(ws) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(called.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n > 0 OR called.labels IS NOT NULL THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN called USING (rid) LEFT JOIN found USING (rid)
"""
