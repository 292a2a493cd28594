"""License scans: fixed phrases, and an exact set-similarity join of text blocks with notices and whole license texts.

Words are longest runs of lower-cased A-Z, digits and characters beyond ASCII. A template's blocks are BLOCK consecutive words,
doubled until half a block holds the template; they start every half block, so any place of up to half a block that holds
enough of a template lies in one. A template is found in a block if at least ``threshold`` of its distinct words are there.
Words are ordered by how many documents hold them, rarest first:
a block that reaches the threshold holds one of a template's first |T| - ceil(threshold * |T|) + 1 words (prefix
filter), has at least ceil(threshold * |T|) words (length filter), and enough words are left after the first ones shared
(positional filter). What passes is verified by intersection, so no block is missed.

DataFrame functions only. Null texts are empty and have no words. Rows with one id and different texts are told
apart by a hash of the text, equal rows stay. Templates are a fixed list, so they are broadcast; one without words is an error.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_columns

#: The phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
]
#: Notices and license texts as their publishers give them.
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
TEXTS = [
    ("gpl", _GNU.format("program", "General Public License", 3)),
    ("lgpl", _GNU.format("library", "Lesser General Public License", 2.1)),
    ("agpl", _GNU.format("program", "Affero General Public License", 3)),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("bsd", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
TEMPLATES += TEXTS
BLOCK = 48
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def word_array(text: Column) -> Column:
    return F.filter(F.split(lowered(text), _BETWEEN), lambda w: w != "")


def places(words: Column, phrase: str) -> Column:
    """Starts, from 0, of the phrase's words in an array."""
    first, *rest = phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.get(words, i) == first
        for k, word in enumerate(rest, 1):
            out = out & F.coalesce(F.get(words, i + k) == word, F.lit(False))
        return out

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.coalesce(here(i), F.lit(False)))


def phrase_scan(rows: DataFrame) -> DataFrame:
    """doc_id, key, n_words, and places: array of (at, label)."""
    tried = "|".join(p.replace(" ", _BETWEEN) for p, _ in PHRASES)

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(places(F.col("words"), phrase), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    found = F.concat(*(labelled(*x) for x in PHRASES))
    base = rows.select("doc_id", "key", lowered(F.col("text")).alias("low")).select("doc_id", "key", F.col("low").rlike(tried).alias("may"), F.filter(F.split("low", _BETWEEN), lambda w: w != "").alias("words"))
    return base.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.when(F.col("may"), found).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")).alias("places"))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def span_of(n_words: int, block: int = BLOCK) -> int:
    """Words of a template's blocks."""
    while block // 2 < n_words:
        block *= 2
    return block


def template_join(rows: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, key, template, label, span, block (its words and its first one), containment, shared: every block that holds enough of a template, and which of its words.

    ``rows`` has doc_id, key and text. Equal rows give the same blocks once.
    """
    spark = rows.sparkSession
    split = [(label, template_words(text)) for label, text in templates]
    if not all(w for _, w in split):
        raise ValueError("a template has no words")
    vocabulary = sorted({w for _, t in split for w in t})
    words = rows.select("doc_id", "key", word_array(F.col("text")).alias("words"))
    counted = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").count()
    frequency = dict(counted.collect())  # a row for each of the templates' words
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    prefixes, lists, spans = [], [], {}
    for i, (label, text) in enumerate(split):
        t, span = sorted(set(text), key=rank.get), span_of(len(text), block)
        need = math.ceil(threshold * len(t) - 1e-9)
        lists.append((i, label, t, need))
        first = t[: len(t) - need + 1]
        prefixes += [(w, span, i, place) for place, w in enumerate(first)]
        own, firsts = spans.setdefault(span, (set(), set()))
        own.update(t)
        firsts.update(first)
    tokens = F.broadcast(spark.createDataFrame(prefixes, "word string, span int, template int, place int"))
    whole = F.broadcast(spark.createDataFrame(lists, "template int, label string, tokens array<string>, need int"))
    literals = lambda ws: F.array(*(F.lit(w) for w in sorted(ws, key=rank.get)))
    none = F.array().cast("array<struct<span:int,block:bigint,own:array<string>,firsts:array<string>,size:int>>")

    def blocks_of(span: int) -> Column:
        own, firsts = (literals(x) for x in spans[span])
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - span // 2 - 1, F.lit(0)), F.lit(span // 2))

        def one(i: Column) -> Column:
            part = F.array_distinct(F.slice("words", i + 1, span))
            # own has the block's template words, rarest first: a block's other words can't be shared.
            return F.struct(F.lit(span).alias("span"), i.cast("long").alias("block"), F.array_intersect(own, part).alias("own"), F.array_intersect(firsts, part).alias("firsts"), F.size(part).alias("size"))

        return F.when(F.arrays_overlap("words", firsts), F.transform(starts, one)).otherwise(none)

    any_first = literals({w for _, firsts in spans.values() for w in firsts})
    blocks = words.where(F.arrays_overlap("words", any_first)).select("doc_id", "key", F.explode(F.concat(*map(blocks_of, sorted(spans)))).alias("b")).select("doc_id", "key", "b.*")
    shared = blocks.select("doc_id", "key", "span", "block", "own", "size", F.explode("firsts").alias("word")).withColumn("at", (F.array_position("own", F.col("word")) - 1).cast("int")).join(tokens, ["word", "span"])
    candidates = shared.join(whole, "template").where((F.col("size") >= F.col("need")) & (F.least(F.size("own") - F.col("at"), F.size("tokens") - F.col("place")) + F.least("at", "place") >= F.col("need")))
    found = candidates.select("doc_id", "key", "span", "block", "template", "label", "need", F.size("tokens").alias("n"), F.array_intersect("own", "tokens").alias("shared")).where(F.size("shared") >= F.col("need"))
    return found.groupBy("doc_id", "key", "span", "block", "template", "label").agg(F.max(F.size("shared") / F.col("n")).alias("containment"), F.first("shared").alias("shared"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row a document: n_words, n_base, first_word, last_word, base_labels, labels (both kinds) and score.

    A block gives the label of every template found in it, but of one that has no word there of its own: templates contained to larger
    parts share them all, as a notice of one license holds most words of its relatives'. The score is 1 with a phrase, else the largest containment
    of a template that was found, else 0.
    """
    rows = text_columns(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    found = template_join(rows, templates, threshold).groupBy("doc_id", "key", "span", "block").agg(F.collect_list(F.struct("containment", "label", "shared")).alias("all"))
    better = lambda x: F.flatten(F.transform(F.filter("all", lambda y: y["containment"] > x["containment"]), lambda y: y["shared"]))
    hidden = lambda x: F.size(F.array_except(x["shared"], better(x))) == 0
    best = found.select("doc_id", "key", F.array_max(F.transform("all", lambda x: x["containment"])).alias("containment"), F.transform(F.filter("all", lambda x: ~hidden(x)), lambda x: x["label"]).alias("best"))
    blocks = best.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("best"))).alias("more"), F.max("containment").alias("containment"))
    base = phrase_scan(rows).select("doc_id", "key", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places")["at"].alias("first_word"), F.array_max("places")["at"].alias("last_word"), F.array_distinct(F.transform("places", lambda p: p["label"])).alias("own"))
    both = base.join(blocks, ["doc_id", "key"], "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("own"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", none))), ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
