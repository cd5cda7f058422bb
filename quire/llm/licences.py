"""Licence recognition by sentence rules, with column functions only.

A text is normalised and cut into pieces at line breaks and punctuation. A known
licence sentence is a run of whole pieces: line breaks, blank lines, colons and
semicolons may lie within it, as in wrapped notices, but not the end of a sentence.
Where several begin, the longest counts. The sequence of identifiers found, in the
order of the text, is held against the ordered rules: a rule is a run of identifiers, which
other sentences may interrupt; where it matches it takes its identifiers away, so
that a full notice is recognised before its parts are. All of it happens within a
row, without a shuffle.

Edge cases: null and empty texts have no sentence and no licence. Repeated rows
are scanned each on its own. Known sentences that no rule takes are reported as
left over. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence notices (lower case, runs of other characters than a-z and 0-9 as one space).
SENTENCES = {
    "apache_short": "licensed under the apache license version 2 0",
    "apache_grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_short": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3_short": "licensed under the gnu general public license version 3",
    "gpl3_grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by_nd": "licensed under cc by nd 4 0",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_as_is": "this software is provided by as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "reserved": "all rights reserved",
    "mit_liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl_copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl21_grant": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_grant": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_see": "see the gnu lesser general public license for more details",
    "agpl3_grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_see": "see the gnu affero general public license for more details",
    "mpl2_grant": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_name": "neither the name of nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_use": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost_short": "distributed under the boost software license version 1 0",
    "epl2_grant": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "bsd_short": "licensed under the bsd license",
    "gpl2_short": "licensed under the gnu general public license version 2",
    "cc0_short": "cc0 1 0 universal",
    "spdx_apache": "spdx license identifier apache 2 0",
    "spdx_mit": "spdx license identifier mit",
    "spdx_bsd2": "spdx license identifier bsd 2 clause",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "spdx_gpl2": "spdx license identifier gpl 2 0 only",
    "spdx_gpl2_later": "spdx license identifier gpl 2 0 or later",
    "spdx_gpl3": "spdx license identifier gpl 3 0 only",
    "spdx_gpl3_later": "spdx license identifier gpl 3 0 or later",
    "spdx_lgpl21_later": "spdx license identifier lgpl 2 1 or later",
    "spdx_agpl3_later": "spdx license identifier agpl 3 0 or later",
    "spdx_mpl2": "spdx license identifier mpl 2 0",
    "spdx_isc": "spdx license identifier isc",
    "spdx_cc0": "spdx license identifier cc0 1 0",
}
# Ordered rules: the first that matches takes its sentences. A third part names sentences that must not stand within it.
RULES = (
    ("Apache-2.0", ("apache_grant", "apache_copy", "apache_as_is", "apache_see")),
    ("Apache-2.0", ("apache_grant", "apache_copy")),
    ("Apache-2.0", ("apache_grant",)),
    ("Apache-2.0", ("apache_short",)),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_under",)),
    ("AGPL-3.0-or-later", ("agpl3_grant", "gpl_hope", "agpl_see")),
    ("AGPL-3.0-or-later", ("agpl3_grant",)),
    ("LGPL-2.1-or-later", ("lgpl21_grant", "lgpl_hope", "lgpl_see")),
    ("LGPL-2.1-or-later", ("lgpl21_grant",)),
    ("LGPL-3.0-or-later", ("lgpl3_grant", "lgpl_hope", "lgpl_see")),
    ("LGPL-3.0-or-later", ("lgpl3_grant",)),
    ("GPL-3.0-or-later", ("gpl3_grant", "gpl_hope", "gpl_see", "gpl_copy")),
    ("GPL-3.0-or-later", ("gpl3_grant", "gpl_hope", "gpl_see")),
    ("GPL-3.0-or-later", ("gpl3_grant",)),
    ("GPL-2.0-or-later", ("gpl2_grant", "gpl_hope", "gpl_see", "gpl_copy")),
    ("GPL-2.0-or-later", ("gpl2_grant", "gpl_hope", "gpl_see")),
    ("GPL-2.0-or-later", ("gpl2_grant",)),
    ("GPL-3.0", ("gpl3_short",)),
    ("GPL-2.0", ("gpl2_short",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_author", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is"), ("bsd_name", "bsd_author")),
    ("BSD", ("bsd_grant", "bsd_as_is")),
    ("BSD", ("bsd_short",)),
    ("MPL-2.0", ("mpl2_grant", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_grant",)),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("ISC", ("isc_grant",)),
    ("Unlicense", ("unlicense_free", "unlicense_use")),
    ("Unlicense", ("unlicense_free",)),
    ("Zlib", ("zlib_as_is", "zlib_liable", "zlib_grant")),
    ("BSL-1.0", ("boost_short",)),
    ("EPL-2.0", ("epl2_grant",)),
    ("CC0-1.0", ("cc0_short",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-ND-4.0", ("cc_by_nd",)),
    ("Apache-2.0", ("spdx_apache",)),
    ("MIT", ("spdx_mit",)),
    ("BSD-2-Clause", ("spdx_bsd2",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("GPL-2.0", ("spdx_gpl2",)),
    ("GPL-2.0-or-later", ("spdx_gpl2_later",)),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("GPL-3.0-or-later", ("spdx_gpl3_later",)),
    ("LGPL-2.1-or-later", ("spdx_lgpl21_later",)),
    ("AGPL-3.0-or-later", ("spdx_agpl3_later",)),
    ("MPL-2.0", ("spdx_mpl2",)),
    ("ISC", ("spdx_isc",)),
    ("CC0-1.0", ("spdx_cc0",)),
)
# Cuts in a normalised text, which is in lower case otherwise: the end of a sentence, and a break that a sentence may run across.
END, BREAK = "E", "B"
SPACE = r"[ \t\n\x0b\f\r]"
# In this order: mark the cuts, normalise, make one cut of those without words between. Each pattern is linear in the text.
NORMAL = ((f"[.!?]{SPACE}", END), (f"[:;]{SPACE}|\\n", BREAK), (f"[^a-z0-9{END}{BREAK}]+", " "), (f" ?{BREAK}[ {BREAK}]*", BREAK), (f"[ {BREAK}]?{END}[ {BREAK}{END}]*", END))
#: Slots, which known sentences leave empty: names of owners, what is licensed, and the scheme of a link.
NAME = f"[a-z0-9 {BREAK}{END}]{{1,150}}?"
SLOTS = (
    ("https", "http"),
    (f"neither[ {BREAK}]the[ {BREAK}]names?[ {BREAK}]of[ {BREAK}]{NAME}[ {BREAK}{END}]nor[ {BREAK}]the[ {BREAK}]names[ {BREAK}]of", "neither the name of nor the names of"),
    (f"this[ {BREAK}]software[ {BREAK}]is[ {BREAK}]provided[ {BREAK}]by[ {BREAK}]{NAME}[ {BREAK}{END}]as[ {BREAK}]is[ {BREAK}]and", "this software is provided by as is and"),
    (f"([{END}{BREAK}])(?:this|the)[ {BREAK}][a-z0-9]{{1,20}}[ {BREAK}]is[ {BREAK}](?:licensed|released|distributed|available)[ {BREAK}]under[ {BREAK}]the[ {BREAK}](?:terms[ {BREAK}]of[ {BREAK}]the[ {BREAK}])?", "$1licensed under the "),
)
#: An SPDX expression of up to five licences becomes as many sentences; "or later" isn't one of its operators.
SPDX = ((" or later", " or_later"), *[(f"(spdx license identifier[ {BREAK}][a-z0-9_ ]{{1,60}}?) (?:or|and|with) ", f"$1{END}spdx license identifier ")] * 4, ("or_later", "or later"))
STEPS = (*NORMAL, *SLOTS, *SPDX)


def _mark(i: int) -> str:
    """One character that stands for a known sentence."""
    return chr(0xE000 + i)


def sentence_marks(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The known sentences of a text in order, a character each."""
    known = F.create_map(*[F.lit(x) for i, s in enumerate(sentences.values()) for x in (s, _mark(i))])
    cut = F.concat(F.lit(END), F.lower(F.coalesce(text, F.lit(""))), F.lit(END))
    for pattern, by in STEPS:
        cut = F.regexp_replace(cut, pattern, by)
    runs = "|".join(s.replace(" ", f"[ {BREAK}]") for s in sorted(sentences.values(), key=len, reverse=True))
    found = F.regexp_extract_all(cut, F.lit(f"[{END}{BREAK}]({runs})(?=[{END}{BREAK}])"), F.lit(1))
    return F.array_join(F.transform(found, lambda s: F.element_at(known, F.translate(s, BREAK, " "))), "")


def _pattern(sentences: dict[str, str], run: tuple[str, ...], barred: tuple[str, ...] = ()) -> tuple[str, int]:
    """A rule as a pattern over marks; the groups are the sentences that interrupt it."""
    own, never = ([_mark(list(sentences).index(name)) for name in names] for names in (run, barred))
    return f"([^{''.join(own + never)}]*)".join(own), len(own) - 1


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """A row for each row with a known sentence: the id, sentences, licences (both comma-joined, in order), left_over.

    Licences are listed in the order of the rules that match, each once.
    """
    rows = docs.select(F.col(id_col), sentence_marks(F.col(text_col), sentences).alias("_marks")).where("_marks != ''")
    rows = rows.withColumn("_left", F.col("_marks")).withColumn("_found", F.array().cast("array<string>"))
    for licence, *parts in rules:
        pattern, groups = _pattern(sentences, *parts)
        found = F.when(F.col("_left").rlike(pattern), F.array_append("_found", F.lit(licence))).otherwise(F.col("_found"))
        left = F.regexp_replace("_left", pattern, "".join(f"${i + 1}" for i in range(groups)))
        rows = rows.select(id_col, "_marks", found.alias("_found"), left.alias("_left"))
    names = F.create_map(*[F.lit(x) for i, name in enumerate(sentences) for x in (_mark(i), name)])
    named = lambda c: F.array_join(F.transform(F.filter(F.split(c, ""), lambda m: m != ""), lambda m: F.element_at(names, m)), ",")
    return rows.select(id_col, named("_marks").alias("sentences"), F.array_join(F.array_distinct("_found"), ",").alias("licences"), named("_left").alias("left_over"))


def sql(rules: tuple = RULES, sentences: dict[str, str] = SENTENCES) -> str:
    """DuckDB SQL for scanned() over documents. Its patterns know no look-ahead, so each cut stands twice: one ends a sentence, one begins the next."""
    values = ", ".join(f"('{s}', chr({0xE000 + i}), '{name}')" for i, (name, s) in enumerate(sentences.items()))
    cut = f"'{END}' || lower(text) || '{END}'"
    for pattern, by in STEPS:
        cut = f"regexp_replace({cut}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    runs = "|".join(s.replace(" ", f"(?: |{BREAK}{BREAK})") for s in sorted(sentences.values(), key=len, reverse=True))
    found = f"regexp_extract_all(replace(replace({cut}, '{END}', '{END}{END}'), '{BREAK}', '{BREAK}{BREAK}'), '[{END}{BREAK}]({runs})[{END}{BREAK}]', 1)"
    steps, at = [], "r0"
    for k, (licence, *parts) in enumerate(rules, 1):
        pattern, groups = _pattern(sentences, *parts)
        back = "".join(f"\\{i + 1}" for i in range(groups))
        steps.append(f"r{k} AS (SELECT doc_id, marks, CASE WHEN regexp_matches(rest, '{pattern}') THEN list_append(found, '{licence}') ELSE found END AS found, regexp_replace(rest, '{pattern}', '{back}', 'g') AS rest FROM {at})")
        at = f"r{k}"
    named = "coalesce((SELECT string_agg(name, ',' ORDER BY i) FROM (SELECT unnest(string_split({0}, '')) AS c, generate_subscripts(string_split({0}, ''), 1) AS i) u JOIN known ON mark = c), '')"
    return f"""WITH known(sentence, mark, name) AS (VALUES {values}),
parts AS (SELECT k, doc_id, i, replace(s, '{BREAK}{BREAK}', ' ') AS n FROM (SELECT k, doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT row_number() OVER () AS k, doc_id, {found} AS p FROM documents))),
r0 AS (SELECT any_value(doc_id) AS doc_id, string_agg(mark, '' ORDER BY i) AS marks, CAST([] AS VARCHAR[]) AS found, string_agg(mark, '' ORDER BY i) AS rest FROM parts JOIN known ON n = sentence GROUP BY k),
{", ".join(steps)}
SELECT doc_id, {named.format("marks")} AS sentences, coalesce(list_aggregate(list_filter(found, lambda x, i: list_position(found, x) = i), 'string_agg', ','), '') AS licences, {named.format("rest")} AS left_over FROM {at}"""
