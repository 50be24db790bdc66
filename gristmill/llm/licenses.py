"""Licence scans by sentence rules, in built-in expressions alone.

A text is cut into sentences, which are normalised (lower case, letters and
digits) and looked up among known licence sentences. The identifiers found, in
order of appearance, form a sequence; ordered rules over identifiers name the
licences in it, earlier (longer) rules first.

A sentence that gives a notice is brought to one form first: what is licensed and
where the text of the licence is found are left out, and the verbs for it are one
(`NOTICE`). A notice has one of the words of `ANCHORS`. So `This project is released under the MIT License (see LICENSE).` is
the sentence `under mit`. SPDX tags are notices too.

A text is cut twice: with line ends as sentence ends (a notice on a line of its
own), and with line ends as spaces and blank lines as sentence ends (a licence
text wrapped over lines); both sequences are matched. Texts without any of a few words that every known
sentence has are passed over early.

Defined results: null and empty texts have no sentences and no licences; rows
with null or repeated doc_id are scanned each for itself; extra columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import others, private, public

# Sentences of public licences, normalised, by identifier.
SENTENCES = {
    "apache-notice-long": "under apache license version 2 0 the",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "rights-reserved": "all rights reserved",
}

# Licence by sequence of sentence identifiers, in order of preference.
RULES = (
    ("Apache-2.0", ("apache-notice-long", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("under-apache-2-0", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-notice-long",)),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-title",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("Proprietary", ("rights-reserved",)),
)

# SPDX identifiers, and the names that notices give the licences, normalised.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0", "apache license v2 0"),
    "MIT": ("mit",),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3 0", "gplv3", "gpl v3", "gpl 3 0"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2 0", "gplv2", "gpl v2", "gpl 2 0"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gnu general public license v3 0 or later"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gnu general public license v2 0 or later"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "lgplv3", "lgpl 3 0"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "lgpl 2 1"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "agplv3", "agpl 3 0"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd"),
    "ISC": ("isc",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license version 2 0"),
    "Unlicense": ("unlicense",),
    "0BSD": ("bsd zero clause",),
    "BSL-1.0": ("boost software license 1 0", "boost software license version 1 0"),
    "Zlib": ("zlib",),
    "CC0-1.0": ("cc0 1 0", "cc0"),
    **{f"CC-BY{x}-4.0": (f"cc by{x.lower().replace('-', ' ')} 4 0", f"creative commons attribution{long} 4 0 international") for x, long in (
        ("", ""), ("-SA", " sharealike"), ("-NC", " noncommercial"), ("-ND", " noderivatives"), ("-NC-SA", " noncommercial sharealike"), ("-NC-ND", " noncommercial noderivatives"),
    )},
}


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


for _name, _ways in NAMES.items():
    for _way in dict.fromkeys((_plain(_name), *_ways)):
        _mark = ("under-" + _way).replace(" ", "-")
        SENTENCES[_mark] = f"under {_way}"
        RULES += ((_name, (_mark,)),)

#: Brings notices to one form, step by step: pattern and what it becomes (both in Java's and DuckDB's syntax).
NOTICE = (
    (r"^spdx license identifier ", "under "),
    (r" (see|in|as in) (the )?(file )?(license|licence|copying)( (file|txt|md))*( file)?( for (more |the )?(details|information|text|terms))?$", ""),
    (r"^(this|the|all|our|its) (source |example |sample )?(project|software|code|library|package|work|file|files|program|repository|data|dataset|content|text|document|documentation|module|crate|plugin) ", ""),
    (r"^(code|software|content|documentation|source code) ", ""),
    (r"^(is |are |was |has been |have been |made )+", ""),
    (r"^(dual |also |freely |made )*(licensed|licenced|released|distributed|available|published|provided|offered|shared) (for use )?under ", "under "),
    (r"^under (the )?(terms of )?(the )?", "under "),
    (r"^(under .*[^ ]) licen[sc]e$", "$1"),
)


#: Other sentences give no notice.
MAYBE = "(^| )under |^spdx license identifier "


def notice_form(sentence: Column) -> Column:
    for pattern, becomes in NOTICE:
        sentence = F.regexp_replace(sentence, pattern, becomes)
    return sentence


#: A text without one of these has no known sentence.
ANCHORS = "[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|[Cc][Oo][Pp][Yy]|[Pp][Ee][Rr][Mm][Ii][Ss][Ss][Ii][Oo][Nn]|[Rr][Ee][Dd][Ii][Ss][Tt]|[Pp][Rr][Oo][Gg][Rr][Aa][Mm]|[Ww][Aa][Rr][Rr][Aa][Nn][Tt]|[Rr][Ii][Gg][Hh][Tt][Ss]|[Ss][Oo][Ff][Tt][Ww][Aa][Rr][Ee]"


SPDX = "([Ss][Pp][Dd][Xx]-[Ll][Ii][Cc][Ee][Nn][SsCc][Ee]-[Ii][Dd][Ee][Nn][Tt][Ii][Ff][Ii][Ee][Rr]):[ \t]*"


def sequence_pattern() -> str:
    """All rules as one pattern over '<id>' marks; of rules that begin at one mark the first wins."""
    return "(" + "|".join("".join(f"<{s}>" for s in ids) for _, ids in RULES) + ")"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _marks(text: Column, known: Column) -> Column:
    """Identifiers of known sentences in order, each as '<id>'."""
    tagged = F.regexp_replace(text, SPDX, "$1 ")
    sentences = F.split(F.regexp_replace(tagged, "([.!?:;])[ \t\r]+", "$1\n"), "\n")
    anchored = F.filter(sentences, lambda s: s.rlike(ANCHORS))
    plain = F.transform(anchored, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    found = F.transform(plain, lambda s: F.coalesce(known[s], F.when(s.rlike(MAYBE), known[notice_form(s)])))
    return F.array_join(F.transform(F.filter(found, lambda k: k.isNotNull()), lambda k: F.concat(F.lit("<"), k, F.lit(">"))), "")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (marks found, lines as sentences), licenses (sorted) and n_known."""
    known = _literal_map({v: k for k, v in SENTENCES.items()})
    names = _literal_map({"".join(f"<{s}>" for s in ids): name for name, ids in RULES})
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    candidate = whole.rlike(ANCHORS)
    by_line = F.when(candidate, _marks(whole, known)).otherwise("")
    paragraphs = F.regexp_replace(whole, "\n[ \t\r]*\n", ". ")
    wrapped = F.when(candidate, _marks(F.regexp_replace(paragraphs, "[ \t\r]*\n[ \t\r]*", " "), known)).otherwise("")
    found = lambda c: F.transform(F.regexp_extract_all(c, F.lit(sequence_pattern()), F.lit(1)), lambda m: names[m])
    columns = others(docs, "sentence_ids", "licenses", "n_known")
    rows = private(docs, columns, lines=by_line, wrapped=wrapped)
    return rows.select(
        *public(columns),
        F.col("lines").alias("sentence_ids"),
        F.array_sort(F.array_union(found(F.col("lines")), found(F.col("wrapped")))).alias("licenses"),
        (F.length("lines") - F.length(F.replace(F.col("lines"), F.lit("<"), F.lit("")))).cast("long").alias("n_known"),
    )
