"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences; each is normalised and looked up among known license sentences; the sequence of identifiers
that a text shows is then matched against rules, in their order, each of which takes the identifiers it explains.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, spare_name

#: Identifier -> sentence, as published with the licenses.
SENTENCES = {
    "apache-under": "Licensed under the Apache License, Version 2.0",
    "apache-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-released": "Released under the MIT License",
    "mit-under": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-short-title": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-either": "either version 2 of the License, or (at your option) any later version",
    "gpl-published": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-no-warranty-2": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "gpl3-either": "either version 3 of the License, or (at your option) any later version",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
    "lgpl-free": "This library is free software",
    "lgpl-published": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-either": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl-no-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl-published": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "bsl-under": "Distributed under the Boost Software License, Version 1.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "This work is dedicated to the public domain under CC0 1.0",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "spdx": "SPDX-License-Identifier",
    "id-mit": "MIT",
    "id-apache": "Apache-2.0",
    "id-gpl3": "GPL-3.0-or-later",
    "id-gpl3-only": "GPL-3.0-only",
    "id-bsd3": "BSD-3-Clause",
    "id-bsd2": "BSD-2-Clause",
    "id-mpl2": "MPL-2.0",
    "id-gpl2": "GPL-2.0-or-later",
    "id-gpl2-only": "GPL-2.0-only",
    "id-lgpl21": "LGPL-2.1-or-later",
    "id-lgpl21-only": "LGPL-2.1-only",
    "id-lgpl3": "LGPL-3.0-or-later",
    "id-agpl3": "AGPL-3.0-or-later",
    "id-isc": "ISC",
    "id-0bsd": "0BSD",
    "id-epl2": "EPL-2.0",
    "id-bsl": "BSL-1.0",
    "id-cc0": "CC0-1.0",
    "id-unlicense": "Unlicense",
    "id-zlib": "Zlib",
}
#: Fixed values: (license, its sequence of identifiers); longer sequences come before their parts.
RULES = (
    ("Apache-2.0", ("apache-the", "apache-may-not", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-the", "apache-may-not", "apache-obtain")),
    ("Apache-2.0", ("apache-the", "apache-may-not")),
    ("Apache-2.0", ("spdx", "id-apache")),
    ("Apache-2.0", ("apache-the",)),
    ("Apache-2.0", ("apache-under",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-short-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("spdx", "id-mit")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-under",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-short-title",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-disclaimer")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("spdx", "id-bsd3")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("spdx", "id-bsd2")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms", "gpl-no-warranty", "gpl-no-warranty-2", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0-or-later", ("spdx", "id-gpl3")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("spdx", "id-gpl3-only")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-published", "gpl2-either", "gpl-no-warranty", "gpl-no-warranty-2", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-published", "gpl2-either")),
    ("GPL-2.0-or-later", ("spdx", "id-gpl2")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-published", "gpl3-either", "gpl-no-warranty", "gpl-no-warranty-2", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-published", "gpl3-either")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only", "gpl-no-warranty", "gpl-no-warranty-2", "gpl-see")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only-terms")),
    ("GPL-2.0-only", ("spdx", "id-gpl2-only")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-published", "lgpl21-either", "lgpl-no-warranty", "gpl-no-warranty-2", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-published", "lgpl21-either")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl-published", "lgpl21-either")),
    ("LGPL-2.1-or-later", ("spdx", "id-lgpl21")),
    ("LGPL-2.1-only", ("spdx", "id-lgpl21-only")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-published", "gpl3-either")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-published", "gpl3-either")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-terms")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-terms")),
    ("LGPL-3.0-or-later", ("spdx", "id-lgpl3")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms", "gpl-no-warranty", "gpl-no-warranty-2", "agpl-see")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-published", "gpl3-either")),
    ("AGPL-3.0-or-later", ("spdx", "id-agpl3")),
    ("MPL-2.0", ("spdx", "id-mpl2")),
    ("ISC", ("spdx", "id-isc")),
    ("0BSD", ("spdx", "id-0bsd")),
    ("0BSD", ("0bsd-grant",)),
    ("EPL-2.0", ("spdx", "id-epl2")),
    ("BSL-1.0", ("spdx", "id-bsl")),
    ("CC0-1.0", ("spdx", "id-cc0")),
    ("Unlicense", ("spdx", "id-unlicense")),
    ("Zlib", ("spdx", "id-zlib")),
    ("EPL-2.0", ("epl2-terms",)),
    ("BSL-1.0", ("bsl-under",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
)
#: A sentence ends at . ; : ! or ? before white space; a line or a paragraph ends one as well. The point of "v. 2" ends none.
_VERSION = r"(?<![a-z0-9])(v)\.[\x20\x09\n]+(?=[0-9])"
_ENDS = r"([.;:!?])[\x20\x09-\x0D]+"


def normal_sentence(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


#: Stands for a line break within a paragraph, where a sentence may or may not end.
_SOFT = "\x01"


def _sentences(text: Column) -> Column:
    """The sentences of the paragraphs, each as the lines that it is on."""
    joined = F.regexp_replace(F.translate(text, _SOFT, "-"), r"\n[\x20\x09-\x0D]*\n", ".\n")
    joined = F.regexp_replace(joined, r"([^.;:!?])\n", "$1" + _SOFT)
    marked = F.regexp_replace(joined, _ENDS, "$1\n")
    sentences = F.split(F.regexp_replace(marked, r"[^a-z0-9\n\x01]+", " "), r" ?\n[ \n]*")
    return F.transform(sentences, lambda s: F.filter(F.transform(F.split(s, _SOFT), lambda p: F.trim(p)), lambda p: p != ""))


#: The sentence that license identifiers follow, and what stands between them ("or later" is part of one).
_SPDX, _BETWEEN = normal_sentence(SENTENCES["spdx"]), r" (?:or(?! later\b)|and|with) "


def _known(sentences: Column, known: dict[str, str]) -> Column:
    """The identifiers of each sentence: from the left, the longest run of its lines that is a known sentence, then on behind it.

    A run has as many lines as the longest known sentence has words at most, and is tried only where a line begins like a known
    sentence. After an SPDX tag, each identifier of an expression counts as tagged. sentences is a column, so that it is cut once.
    """
    by_text = {normal_sentence(s): i for i, s in known.items()}
    ids = F.create_map(*(F.lit(x) for s, i in by_text.items() for x in (s, i)))
    named = lambda s: F.when(s.isin([*by_text]), F.element_at(ids, s))  # noqa: E731  a hash set answers first
    beginnings = {" ".join(s.split(" ")[:n]) for s in by_text for n in (1, 2)}
    longest = max((len(s.split(" ")) for s in by_text), default=1)
    tagged = any(normal_sentence(s) == _SPDX for s in known.values())

    def run_from(parts: Column, line: Column, i: Column) -> Column:
        """(lines, id) of the longest known run from a line, else null."""
        tries = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(parts) - i)), lambda n: F.struct(n.alias("lines"), named(F.array_join(F.slice(parts, i + 1, n), " ")).alias("id")))
        return F.when(F.substring_index(line, " ", 2).isin([*beginnings]), F.array_max(F.filter(tries, lambda t: t["id"].isNotNull())))

    def step(acc: Column, run: Column) -> Column:
        here = run.isNotNull() & (acc["i"] >= acc["free"])
        return F.struct((acc["i"] + 1).alias("i"), F.when(here, acc["i"] + run["lines"]).otherwise(acc["free"]).alias("free"), F.when(here, F.concat(acc["ids"], F.array(run["id"]))).otherwise(acc["ids"]).alias("ids"))

    def chosen(runs: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("free"), F.array().cast("array<string>").alias("ids"))
        return F.when(F.exists(runs, lambda r: r.isNotNull()), F.aggregate(runs, start, step, lambda acc: acc["ids"])).otherwise(F.array().cast("array<string>"))

    def read(parts: Column) -> Column:
        several = chosen(F.transform(parts, lambda line, i: run_from(parts, line, i)))
        return F.when(F.size(parts) > 1, several).otherwise(F.filter(F.transform(parts, named), lambda i: i.isNotNull()))

    def expression(parts: Column, i: Column) -> Column:
        """The first line after a tag: its identifiers one by one, a tag before each but the first."""
        after = F.try_element_at(F.when(i > 0, F.get(sentences, i - 1)), F.lit(-1)) == _SPDX
        first = F.split(F.regexp_replace(F.get(parts, F.lit(0)), _BETWEEN, _SOFT + _SPDX + _SOFT), _SOFT)
        return F.when(F.coalesce(after, F.lit(False)), F.concat(first, F.slice(parts, 2, F.size(parts)))).otherwise(parts)

    return F.flatten(F.transform(sentences, (lambda parts, i: read(expression(parts, i))) if tagged else read))


def licensed(documents: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: tuple = RULES) -> DataFrame:
    """documents with n_sentences, n_known, ids, licenses, n_left.

    ids has the identifiers of the known sentences in their order. A known sentence may be one line or wrapped over any lines of its
    paragraph, whatever stands on the lines around it. Rules apply in their order; each takes every
    run of identifiers that equals its sequence; licenses has the names found, sorted and distinct; n_left counts the
    identifiers that no rule took. Null and empty texts have no sentences. Every row stays one row; columns with the
    names of the result are replaced.
    """
    known = SENTENCES if sentences is None else sentences
    lower = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    cut = spare_name(documents, "sentences")
    out = documents.withColumn(cut, _sentences(F.regexp_replace(lower, _VERSION, "$1 ")))
    out = out.withColumns({"n_sentences": F.aggregate(cut, F.lit(0).cast("long"), lambda n, s: n + F.size(s)), "ids": _known(F.col(cut), known)}).drop(cut)
    left = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    for name, sequence in rules:
        left = F.replace(left, F.lit("," + ",,".join(sequence) + ","), F.lit(f",<{name}>,"))
    rest = spare_name(out, "rest")
    out = out.withColumn(rest, F.filter(F.split(left, ",+"), lambda x: x != ""))
    names = F.array_sort(F.array_distinct(F.transform(F.filter(rest, lambda x: F.startswith(x, F.lit("<"))), lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))))
    out = out.withColumns({"n_known": F.size("ids").cast("long"), "licenses": names, "n_left": F.size(F.filter(rest, lambda x: ~F.startswith(x, F.lit("<")))).cast("long")})
    return out.drop(rest)


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_sentences", "n_known", F.array_join("ids", " ").alias("ids"), F.array_join("licenses", ",").alias("licenses"), "n_left")


def oracle_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(normal_sentence(s))}, {quoted(i)})" for i, s in SENTENCES.items())
    left = "',' || array_to_string(ids, ',,') || ','"
    for name, sequence in RULES:
        left = f"replace({left}, {quoted(',' + ',,'.join(sequence) + ',')}, {quoted(f',<{name}>,')})"
    return rf"""
with recursive t as (select doc_id, regexp_replace(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(1), '-'), '(^|[^a-z0-9])v\.[\x20\x09\n]+([0-9])', '\1v \2', 'g') as x from documents),
known(sentence, id) as (values {known}),
y as (select doc_id, regexp_replace(regexp_replace(x, '\n[\x20\x09-\x0D]*\n', '.' || chr(10), 'g'), '([^.;:!?])\n', '\1' || chr(1), 'g') as y from t),
c as (select doc_id, string_split_regex(regexp_replace(regexp_replace(y, '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[^a-z0-9\n\x01]+', ' ', 'g'), ' ?\n[ \n]*') as ss from y),
s as (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as n from c),
w as (select doc_id, n, list_filter(list_transform(string_split(s, chr(1)), lambda z: trim(z)), lambda z: z <> '') as parts from s),
e as (select doc_id, n, len(parts) as k, case when coalesce(lag(parts[len(parts)]) over (partition by doc_id order by n), '') = '{_SPDX}' and len(parts) > 0
    then list_concat(string_split(replace(regexp_replace(regexp_replace(parts[1], ' or later\b', ' or_later', 'g'), ' (?:or|and|with) ', chr(1) || '{_SPDX}' || chr(1), 'g'), ' or_later', ' or later'), chr(1)), parts[2:]) else parts end as parts from w),
p as (select doc_id, n, unnest(parts) as line, generate_subscripts(parts, 1) as m, array_to_string(parts, ' ') as whole from e),
-- each known sentence is looked for in the sentence without its line breaks, from where a line begins to where one ends
o as (select *, 1 + coalesce(sum(length(line) + 1) over (partition by doc_id, n order by m rows between unbounded preceding and 1 preceding), 0) as place from p),
h as (select o.doc_id, o.n, o.m, id, length(sentence) as z, o.place + length(sentence) as stop, length(whole) as whole_z from o join known on split_part(line, ' ', 1) = split_part(sentence, ' ', 1) and substr(whole, cast(place as integer), length(sentence)) = sentence),
b as (select h.doc_id, h.n, h.m, arg_max(id, z) as id, arg_max(coalesce(q.m, 1000000000), z) as next_m from h left join o q on q.doc_id = h.doc_id and q.n = h.n and q.place = h.stop + 1 where h.stop = whole_z + 1 or q.m is not null group by 1, 2, 3),
g as (
  (select distinct on (doc_id, n) doc_id, n, m, id, next_m from b order by doc_id, n, m)
  union all
  select doc_id, n, m, id, next_m from (select b.*, row_number() over (partition by b.doc_id, b.n order by b.m) as first from g join b on b.doc_id = g.doc_id and b.n = g.n and b.m >= g.next_m) where first = 1),
kn as (select doc_id, n, list(id order by m) as ids from g group by 1, 2),
r as (select doc_id, n, k, coalesce(kn.ids, []) as ids from e left join kn using (doc_id, n)),
a as (select doc_id, cast(sum(k) as bigint) as n_sentences, flatten(list(ids order by n)) as ids from r group by 1),
f as (select doc_id, n_sentences, ids, list_filter(string_split({left}, ','), lambda z: z <> '') as x from a)
select doc_id, n_sentences, cast(len(ids) as bigint) as n_known, array_to_string(ids, ' ') as ids,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(x, lambda z: starts_with(z, '<')), lambda z: substr(z, 2, length(z) - 2)))), ',') as licenses,
  cast(len(list_filter(x, lambda z: not starts_with(z, '<'))) as bigint) as n_left
from f
"""
