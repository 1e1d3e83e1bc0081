"""Operator 3, licence scans by sentence rules.

A text is cut into pieces at sentence marks and line breaks, each normalised to
its lower-case words without comment marks. A known licence sentence may be one
piece or several in a row (a hard-wrapped text, a colon or "v. 2.0" inside, blank
lines), and becomes its identifier; where two start at one piece, the longer is
taken. A licence rule is an ordered sequence of identifiers; rules are tried in
order, the fuller text before the short notice, and a match uses its sentences up,
so that one grant is reported once. Sentences of other kinds may stand between
those of a rule. Rules run over the array of identifiers, in work proportional to
its length and without a regular expression over it.

The known sentences and rules are small fixed tables and travel as literals in
the plan: one row in, one row out, no shuffle.

Edge cases: null and empty texts have no sentences; repeated sentences give
repeated identifiers, and a rule matches as often as its sequence occurs (the
licence is reported once, at its first rule); ties don't occur as rules have an
order; repeated rows are each scanned; an empty table gives an empty result;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Identifiers and normalised sentences of public licence texts and notices.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2.0",
    "apache-the": "licensed under the apache license version 2.0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is"
                    " distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                 " associated documentation files the software to deal in the software without restriction including"
                 " without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"
                 " of the software and to permit persons to whom the software is furnished to do so subject to the"
                 " following conditions",
    "mit-include": "the above copyright notice and this permission notice shall be included in all copies or substantial"
                   " portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to"
             " the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability"
                  " whether in an action of contract tort or otherwise arising from out of or in connection with the"
                  " software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided"
                 " that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the"
                  " following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and"
                  " the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
                " promote products derived from this software without specific prior written permission",
    "bsd-notice": "licensed under the bsd license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-short": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
                " public license as published by the free software foundation either version 3 of the license or at your"
                " option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                 " general public license as published by the free software foundation either version 2 of the license or"
                 " at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the"
                " implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-notice": "licensed under the gnu lesser general public license version 3",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "mpl-copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc-by-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to"
           " this work",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is"
                 " hereby granted provided that the above copyright notice and this permission notice appear in all"
                 " copies",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero"
                 " general public license as published by the free software foundation either version 3 of the license or"
                 " at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "agpl-received": "you should have received a copy of the gnu affero general public license along with this program",
    "agpl-notice": "licensed under the gnu affero general public license version 3",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu"
                   " lesser general public license as published by the free software foundation either version 2.1 of the"
                   " license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu"
                  " lesser general public license as published by the free software foundation either version 3 of the"
                  " license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the"
                 " implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "lgpl21-notice": "licensed under the gnu lesser general public license version 2.1",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public"
                  " license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public"
                  " license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl"
                  " v10.html",
    "cddl-terms": "the contents of this file are subject to the terms of the common development and distribution license"
                  " the license",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications"
                  " and to alter it and redistribute it freely subject to the following restrictions",
    "boost-notice": "distributed under the boost software license version 1.0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the"
                   " software and accompanying documentation covered by this license the software to use reproduce display"
                   " distribute execute and transmit the software and to prepare derivative works of the software and to"
                   " permit third parties to whom the software is furnished to do so all subject to the following",
    "cc-by-nd": "licensed under cc by nd 4.0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4.0",
    "cc-by-nc-nd": "licensed under cc by nc nd 4.0",
    "cc-by-nd-work": "this work is licensed under a creative commons attribution noderivatives 4.0 international license",
    "cc-by-nc-sa-work": "this work is licensed under a creative commons attribution noncommercial sharealike 4.0"
                        " international license",
    "cc-by-nc-nd-work": "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0"
                        " international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
}
# Fixed values: (licence, identifiers in order); fuller texts first.
RULES = (
    ("Apache-2.0", ("apache-the", "apache-comply", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-the", "apache-comply")),
    ("MIT", ("mit-grant", "mit-include", "as-is", "mit-liable")),
    ("MIT", ("mit-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see", "agpl-received")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("CDDL-1.0", ("cddl-terms", "apache-comply")),
    ("CDDL-1.0", ("cddl-terms",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", ("mpl-form", "mpl-copy-https")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("BSD", ("bsd-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("LGPL-3.0", ("lgpl-notice",)),
    ("LGPL-2.1", ("lgpl21-notice",)),
    ("AGPL-3.0", ("agpl-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("proprietary", ("rights",)),
)
_CHUNK = 64  # identifiers of a short list, in matching
# A piece ends at sentence marks before white space or the end, or at a line break.
CUT = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|[\x0A\x0D]+"
# Between words: anything but ASCII letters, digits, inner dots and other letters.
JOIN = r"[^a-z0-9.\x{0080}-\x{10FFFF}]+"
# Comment marks that are left by JOIN, at the start of a piece: m4, Basic, roff.
COMMENT = r"^(?:dnl|rem|\.+)(?: |$)"


def _normal(piece: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(piece), JOIN, " ")), COMMENT, "")


def _known(sentences: dict[str, str]) -> str:
    """Any of the sentences as whole pieces, in a text like ``\\npiece\\npiece\\n``; the longer first."""
    longest = sorted(sentences.values(), key=len, reverse=True)
    return r"\n(" + "|".join(r"[ \n]".join(map(re.escape, s.split())) for s in longest) + r")(?=\n)"


def _use(ids: Column, rule: Column) -> Column:
    """struct(n, left): how often the rule's identifiers occur in order, each used
    once, and the identifiers that no occurrence used.

    ``a[j]`` counts the identifiers taken as the rule's j-th. One is taken if an
    occurrence that has all before it still waits, the oldest of which it serves; so
    the occurrences end in the order they began, n is the count of the last, and the
    first n taken at each place are the used ones. No occurrence is ever searched
    back for: the work is proportional to the identifiers.
    """
    none = F.transform(rule, lambda _: F.lit(0).cast("long"))

    def take(s: Column, x: Column) -> Column:
        at = F.array_position(rule, x).cast("int")
        ok = (at == 1) | ((at > 1) & (F.get(s["a"], at - 2) > F.get(s["a"], at - 1)))
        return F.struct(
            F.when(ok, F.transform(s["a"], lambda v, j: F.when(j == at - 1, v + 1).otherwise(v))).otherwise(s["a"]).alias("a"),
            F.concat(s["o"], F.array(F.when(ok, F.get(s["a"], at - 1) + 1).otherwise(F.lit(0).cast("long")))).alias("o"))

    def chunk(acc: Column, xs: Column) -> Column:
        # Short lists grow; the long one is a list of them.
        done = F.aggregate(xs, F.struct(acc["a"].alias("a"), F.array().cast("array<bigint>").alias("o")), take)
        return F.transform(F.array(done), lambda d: F.struct(
            d["a"].alias("a"), F.concat(acc["o"], F.array(d["o"])).alias("o")))[0]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / _CHUNK).cast("int")),
                         lambda i: F.slice(ids, i * _CHUNK + 1, F.lit(_CHUNK)))
    run = F.aggregate(chunks, F.struct(none.alias("a"), F.array().cast("array<array<bigint>>").alias("o")), chunk,
                      lambda acc: F.struct(F.element_at(acc["a"], -1).alias("n"), F.flatten(acc["o"]).alias("o")))
    pairs = lambda r: F.arrays_zip(ids.alias("x"), r["o"].alias("o"))
    return F.transform(F.array(run), lambda r: F.struct(
        r["n"].alias("n"), F.when(r["n"] == 0, ids).otherwise(F.transform(
            F.filter(pairs(r), lambda p: (p["o"] == 0) | (p["o"] > r["n"])), lambda p: p["x"])).alias("left")))[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
         sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """One row per document: doc_id, n_sentences (pieces), n_known (known licence
    sentences), sentence_ids (in order) and licenses (in rule order), both
    comma-joined, and n_licenses."""
    prepare(docs.sparkSession)
    known = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (s, i)])
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                      F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), CUT),
                               lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("parts"))
    pieces = F.filter(F.transform("parts", _normal), lambda s: s != "")
    whole = F.concat(F.lit("\n"), F.array_join(pieces, "\n"), F.lit("\n"))
    ids = F.transform(F.regexp_extract_all(whole, F.lit(_known(sentences)), F.lit(1)),
                      lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    rows = src.select("doc_id", F.size("parts").cast("long").alias("n_sentences"), ids.alias("ids"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, rule)).alias("rule")) for name, rule in rules])
    zero = F.struct(F.col("ids").alias("left"), F.array().cast("array<string>").alias("got"))

    def use(acc: Column, rule: Column) -> Column:
        there = F.size(F.array_except(rule["rule"], acc["left"])) == 0
        used = F.transform(F.array(_use(acc["left"], rule["rule"])), lambda u: F.struct(
            u["left"].alias("left"),
            F.when(u["n"] > 0, F.array_union(acc["got"], F.array(rule["name"]))).otherwise(acc["got"]).alias("got")))[0]
        return F.when(there, used).otherwise(acc)

    found = F.when(F.size("ids") > 0, F.aggregate(table, zero, use, lambda acc: acc["got"])) \
             .otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("found", found)
    return rows.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"),
                       F.array_join("ids", ",").alias("sentence_ids"), F.array_join("found", ",").alias("licenses"),
                       F.size("found").cast("long").alias("n_licenses"))
