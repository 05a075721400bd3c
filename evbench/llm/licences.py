"""Licence scan by a positional rare-token index (operator 4); DataFrame functions only.

Words are runs of digits, letters a-z and non-ASCII characters of the lower-cased text.  The index holds, for each word of
the licence templates that isn't a function word, the templates and places where it stands.  Of each template a file looks
up the `rare` words of highest IDF that it holds, IDF being over the templates, so that the words of one licence never displace
another's, and the words of its key phrases.  Each of their occurrences votes for (template, place of the template's start in the file).  Where two different template places agree on a start, the template's
words are laid over the file there; at least `min_share` of them must agree and its mandatory key phrases must stand at their places
word by word.  A template's label is then added to the base labels.

No verified place is missed for `rare`: the key phrases of a template hold at least two places of index words (checked when the index is made), which are
always looked up, and a place that verifies has the key phrases.

The index is as large as the templates, whatever the corpus; texts are scanned once, row by row, and never shuffled.  Null or empty texts: no words, no labels, score 0.  Repeated ids are scanned row by row.  Templates that verify
at several places count once; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, texts

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {a}redistributions of source code must retain the above "
    "copyright notice this list of conditions and the following disclaimer {b}redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution {c}this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
    "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
)
_GNU = "{what} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version} of the license or at your option any later version"

# Texts and notices of public licences, and sentences that name them, in lower case and without punctuation, with the phrases that must be there.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the "
        "following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS + " and noninfringement in no event shall "
        "the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use "
        "or other dealings in the software",
        ("merge publish distribute sublicense", "substantial portions of the software"),
    ),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2", "specific language governing permissions"),
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", _BSD.format(a="1 ", b="2 ", c=""), ("source and binary forms", "merchantability and fitness")),
    Template(
        "bsd",
        _BSD.format(a="1 ", b="2 ", c="3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "),
        ("source and binary forms", "endorse or promote products"),
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", _GNU.format(what="this program", kind="", version="2"), ("gnu general public license", "version 2")),
    Template("gpl-3", _GNU.format(what="this program", kind="", version="3"), ("gnu general public license", "version 3")),
    Template("lgpl", "this library is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("lgpl", _GNU.format(what="this library", kind="lesser ", version="2 1"), ("gnu lesser general public license",)),
    Template("agpl-3", "this work is licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("agpl-3", _GNU.format(what="this program", kind="affero ", version="3"), ("gnu affero general public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("software for any purpose with or without fee",)),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable "
        "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising "
        "out of or in connection with the use or performance of this software",
        ("software for any purpose with or without fee", "author disclaims all warranties"),
    ),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license", "source code form"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
        ("unencumbered software", "dedicate any and all copyright interest"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to "
        "use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented "
        "you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions "
        "must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        ("origin of this software must not be misrepresented",),
    ),
    Template(
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        ("prepare derivative works of the software", "accompanying documentation covered"),
    ),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("verbatim or modified copies", "name is changed")),
    Template(
        "postgresql",
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and "
        "this paragraph and the following two paragraphs appear in all copies",
        ("without a written agreement is hereby granted", "following two paragraphs"),
    ),
)
#: Base phrases: words, label, and which of the words is the least common.
BASE = (("under the mit license", "mit", 2), ("apache license version 2", "apache-2", 0), ("cc by nc", "cc-by-nc", 0))
#: Words of a template that a file looks up besides those of its key phrases.
RARE = 8
#: Words that say nothing about a licence; they are not indexed but do count in the comparison.
FUNCTION_WORDS = frozenset(
    "a above all an and any anyone appear are as at be being but by can changed changing copy do either everyone event except following for form from free has held if in including indirect into is it its long "
    "made make making may means met must name names neither no non nor not of on one open or original other otherwise our out over party people possible real released required shall so subject such terms than "
    "that the their them these this those to two under use used using version was we were what whether which who will with without work would you your 0 1 2 3 4 http www".split()
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _places(words: Column, phrase: str, label: str, anchor: int) -> Column:
    """A lambda body's case: the struct of a base phrase that has its anchor at x, i."""
    parts = phrase.split()

    def case(x: Column, i: Column, otherwise: Column) -> Column:
        fits = x == parts[anchor]
        for k, p in enumerate(parts):
            if k != anchor:
                fits = fits & (F.get(words, i + (k - anchor)) == p)
        return F.when(fits, F.struct((i - anchor).cast("long").alias("at"), F.lit(label).alias("label"))).otherwise(otherwise)

    return case


def base_places(words: Column, base: Sequence[tuple[str, str, int]] = BASE) -> Column:
    cases = [_places(words, *b) for b in base]

    def one(x: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<at:bigint,label:string>")
        for c in cases:
            out = c(x, i, out)
        return out

    return F.filter(F.transform(words, one), lambda p: p.isNotNull())


def index_of(templates: Sequence[Template]) -> list[tuple[str, int, int]]:
    """(word, template, place)"""
    return [(w, t, i) for t, x in enumerate(templates) for i, w in enumerate(x.text.split()) if w not in FUNCTION_WORDS]


def key_places(template: Template) -> list[int]:
    """The places of the template where its key phrases stand, each at its first one."""
    text, places = template.text.split(), set()
    for p in template.phrases:
        parts = p.split()
        at = next((i for i in range(len(text)) if text[i : i + len(parts)] == parts), None)
        if at is None:
            raise ValueError(f"{p!r} isn't in the template of {template.label}")
        places |= {*range(at, at + len(parts))}
    return sorted(places)


def key_words(templates: Sequence[Template]) -> dict[int, set[str]]:
    """template -> the index words of its key phrases; ValueError where they don't make two places of the template."""
    out = {}
    for t, x in enumerate(templates):
        held = [w for i in key_places(x) if (w := x.text.split()[i]) not in FUNCTION_WORDS]
        if len(held) < 2:
            raise ValueError(f"the key phrases of {x.label} hold fewer than two places of index words")
        out[t] = set(held)
    return out


def by_rarity(index: list[tuple[str, int, int]]) -> dict[int, list[str]]:
    """template -> its index words by falling IDF over the templates, then by the word."""
    held: dict[str, set[int]] = {}
    for w, t, _ in index:
        held.setdefault(w, set()).add(t)
    return {t: sorted({w for w, u, _ in index if u == t}, key=lambda w: (len(held[w]), w)) for t in {t for _, t, _ in index}}


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, min_share: float = 0.6, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    index, key = index_of(templates), key_words(templates)
    span = max(len(t.text.split()) for t in templates)
    # a vote is template << 32 | start + span; a word's postings are its votes at place 0, each with template << 32 | word
    postings: dict[str, list[tuple[int, int]]] = {}
    number = {word: k for k, word in enumerate(sorted({word for word, _, _ in index}))}
    for word, t, i in index:
        postings.setdefault(word, []).append(((t << 32) + span - i, (t << 32) + number[word]))
    # each of these is one literal, which the optimizer parses once
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    lookup = constant({word: [{"vote": vote, "own": own} for vote, own in ps] for word, ps in postings.items()}, "map<string,array<struct<vote:bigint,own:bigint>>>")
    rarest = constant([[{"word": word, "own": (t << 32) + number[word], "key": word in key[t]} for word in words] for t, words in sorted(by_rarity(index).items())], "array<array<struct<word:string,own:bigint,key:boolean>>>")
    forms = constant([{"label": x.label, "words": x.text.split(), "keys": key_places(x)} for x in templates], "array<struct<label:string,words:array<string>,keys:array<int>>>")
    indexed = constant(sorted(postings), "array<string>")

    w = F.col("w")
    worded = texts(docs, id_col, text_col).select("doc_id", words_of(F.col("text")).alias("w"))
    present = worded.select("doc_id", "w", F.array_intersect(indexed, w).alias("present"))
    # of each template the words of highest IDF that the file holds, and those of its key phrases
    some = lambda words: F.filter(F.filter(words, lambda x: F.array_contains("present", x["word"])), lambda x, i: (i < rare) | x["key"])
    asked = F.when(F.size("present") > 0, F.flatten(F.transform(rarest, lambda words: F.transform(some(words), lambda x: x["own"])))).otherwise(F.array().cast("array<long>"))
    present = present.withColumn("asked", asked)
    hit = lambda x, i: F.when(F.array_contains("present", x), F.struct(x.alias("word"), i.alias("at")))
    hits = F.when(F.size("present") > 0, F.filter(F.transform(w, hit), lambda h: h.isNotNull())).otherwise(F.array().cast("array<struct<word:string,at:int>>"))
    votes = F.sort_array(F.flatten(F.transform(hits, lambda h: F.transform(F.filter(F.element_at(lookup, h["word"]), lambda p: F.array_contains("asked", p["own"])), lambda p: p["vote"] + h["at"]))))
    voted = present.select("doc_id", "w", base_places(w).alias("base"), votes.alias("votes"))
    # a place votes once for a start, so equal votes are different places
    enough = lambda v, i: F.get(F.col("votes"), i - 1) == v
    agreed = voted.select("doc_id", "w", "base", F.array_distinct(F.filter("votes", enough)).alias("agreed"))
    starts = F.transform("agreed", lambda v: F.struct(F.get(forms, F.shiftright(v, 32).cast("int")).alias("form"), (v.bitwiseAND(F.lit(0xFFFFFFFF)) - span).cast("int").alias("start")))
    laid = F.transform(starts, lambda s: F.struct(s["form"].alias("form"), F.transform(s["form"]["words"], lambda _, j: F.get(w, s["start"] + j)).alias("over")))
    same = lambda s: F.size(F.filter(F.zip_with(s["over"], s["form"]["words"], lambda a, b: a == b), lambda x: x))
    keyed = lambda s: F.forall(s["form"]["keys"], lambda j: F.coalesce(F.get(s["over"], j) == F.get(s["form"]["words"], j), F.lit(False)))
    shares = F.transform(laid, lambda s: F.struct(s["form"]["label"].alias("label"), keyed(s).alias("keyed"), (same(s) / F.size(s["form"]["words"])).alias("share")))
    verified = F.filter(shares, lambda s: (s["share"] >= min_share) & s["keyed"])
    found = agreed.select("doc_id", F.size("w").cast("long").alias("n_words"), "base", F.transform(verified, lambda s: F.struct(s["label"].alias("label"), s["share"].alias("share"))).alias("found"))

    labels = F.array_distinct(F.transform("base", lambda b: b.label))
    every = F.array_union(labels, F.transform("found", lambda s: s.label))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s.share)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str, int]] = BASE, rare: int = RARE, min_share: float = 0.6) -> str:
    """DuckDB SQL that gives the rows of scan() with these parameters over documents."""
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    index = index_of(templates)
    order, key = by_rarity(index), key_words(templates)
    idx = ", ".join(f"({quote(w)}, {t}, {i}, {str(w in key[t]).lower()}, {order[t].index(w)})" for w, t, i in index)
    tpl = ", ".join(f"({t}, {quote(x.label)}, {j}, {quote(w)}, {len(x.text.split())}, {str(j in key_places(x)).lower()})" for t, x in enumerate(templates) for j, w in enumerate(x.text.split()))
    places = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS pos, {quote(label)} AS label FROM flat WHERE w[i : i + {len(p.split()) - 1}] = [{', '.join(map(quote, p.split()))}]" for p, label, _ in base)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL
), flat AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), words AS (
  SELECT doc_id, i - 1 AS pos, w[i] AS word FROM flat
), idx(word, t, place, key, rarity) AS (VALUES {idx}), tpl(t, label, j, word, size, key) AS (VALUES {tpl}),
base AS ({places}),
based AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id
), present AS (
  SELECT DISTINCT doc_id, word FROM words WHERE word IN (SELECT word FROM idx)
), top AS (
  SELECT doc_id, t, word FROM (SELECT doc_id, t, word, key, row_number() OVER (PARTITION BY doc_id, t ORDER BY rarity) AS r FROM present JOIN (SELECT DISTINCT word, t, key, rarity FROM idx) USING (word))
  WHERE r <= {rare} OR key
), agreed AS (
  SELECT doc_id, t, pos - place AS start FROM words JOIN top USING (doc_id, word) JOIN idx USING (word, t) GROUP BY doc_id, t, pos - place HAVING count(DISTINCT place) >= 2
), laid AS (
  SELECT a.doc_id, a.t, a.start, p.label, count(*) FILTER (WHERE w.word = p.word) / p.size AS share, bool_and(coalesce(w.word = p.word, false) OR NOT p.key) AS keyed
  FROM agreed a JOIN tpl p ON p.t = a.t LEFT JOIN words w ON w.doc_id = a.doc_id AND w.pos = a.start + p.j GROUP BY a.doc_id, a.t, a.start, p.label, p.size
), verified AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM laid
  WHERE share >= {min_share} AND keyed GROUP BY doc_id
)
SELECT doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(v.labels, [])))), ','), '') AS labels,
       coalesce(v.share, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN based b USING (doc_id) LEFT JOIN verified v USING (doc_id)
"""


#: Rows of query() in DuckDB.
SQL = sql()


def brute_force(rows: Sequence[tuple[int, str | None]], templates: Sequence[Template] = TEMPLATES, min_share: float = 0.6) -> list[tuple]:
    """The same by laying every template over every place, without an index, for tests on small tables."""
    split = [(i, re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for i, t in rows]
    out = []
    for i, ws in split:
        base = sorted((k, label) for p, label, _ in BASE for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        more: dict[str, float] = {}
        for x in templates:
            tw, keys = x.text.split(), key_places(x)
            for start in range(-len(tw), len(ws)):
                laid = [ws[start + j] if 0 <= start + j < len(ws) else None for j in range(len(tw))]
                share = sum(a == b for a, b in zip(laid, tw, strict=True)) / len(tw)
                if share >= min_share and all(laid[j] == tw[j] for j in keys):
                    more[x.label] = max(more.get(x.label, 0), share)
        own = sorted({b for _, b in base})
        score = max(more.values()) if more else 0.5 if base else 0.0
        out.append((i, len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own), ",".join(sorted({*own, *more})), score))
    return out
