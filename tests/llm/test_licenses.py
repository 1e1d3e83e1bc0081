"""Operator 3 against brute force."""

import random
import re

from riskweave.llm import licenses as L
from riskweave.llm.registry import QUERIES


def brute(text):
    parts = [s for s in re.split(r"[.!?;:]+(?:[ \x09-\x0D]+|\Z)|[\x0A\x0D]+", text or "") if re.search(r"[^ \x09-\x0D]", s)]
    known = {s: i for i, s in L.SENTENCES.items()}
    ids = []
    for p in parts:
        n = " ".join(re.sub(r"[^a-z0-9.\u0080-\U0010ffff]+", " ", p.lower()).split(" ")).strip()
        if n in known:
            ids.append(known[n])
    left, found = list(ids), []
    for name, rule in L.RULES:
        while True:
            # The first place from which the rule's identifiers follow in order (each at its next place, unused).
            hit = None
            for a, x in enumerate(left):
                if x != rule[0]:
                    continue
                used, b = [a], a
                while len(used) < len(rule) and b + 1 < len(left):
                    b += 1
                    if left[b] == rule[len(used)]:
                        used.append(b)
                if len(used) == len(rule):
                    hit = used
                    break
            if hit is None:
                break
            left = [x for i, x in enumerate(left) if i not in hit[1:]]
            left[hit[0]] = "_"
            if name not in found:
                found.append(name)
    return len(parts), len(ids), ",".join(ids), ",".join(found), len(found)


def full(*ids):
    return ". ".join(L.SENTENCES[i].capitalize() for i in ids) + "."


def made():
    mit = full("mit-grant", "mit-include", "as-is", "mit-liable")
    return [None, "", " . ; ", "Nothing here. At all!", f"Some text\n{mit}\nmore", f"{mit}\n{mit}",
            "Licensed under the Apache License, Version 2.0.", "LICENSED under  the\tapache license -- version 2.0",
            "Released under the MIT License.\nAll rights reserved.", full("as-is", "mit-grant"),
            full("bsd-grant", "bsd-source", "bsd-binary"), full("bsd-grant", "bsd-source", "rights", "bsd-binary", "bsd-name"),
            full("apache-the", "cc0", "apache-comply", "apache-copy", "apache-basis", "apache-see"),
            "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
            "x " * 20000 + ". Released under the MIT License; é"]


def test_matches_brute_force(spark):
    rows = [(i, t, "q") for i, t in enumerate(made())] + [(4, made()[4], None), (None, made()[6], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = L.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = made()[6 if r.doc_id is None else r.doc_id]
        assert tuple(r)[1:] == brute(text), text
    assert L.scan(df.limit(0)).count() == 0


def test_finds_licences(spark):
    got = {r.doc_id: r.licenses for r in L.scan(spark.createDataFrame(list(enumerate(made())), "doc_id long, text string")).collect()}
    assert got[4] == got[5] == "MIT" and got[6] == got[7] == "Apache-2.0" and got[8] == "MIT,proprietary"
    assert got[10] == "BSD-2-Clause" and got[11] == "BSD-3-Clause,proprietary" and got[12] == "Apache-2.0,CC0-1.0"
    assert got[13] == "GPL-3.0" and got[14] == "CC-BY-NC-4.0" and got[3] == ""


def test_any_sequence_matches_brute_force(spark):
    rnd = random.Random(2)
    pools = [["mit-grant", "mit-include", "as-is", "mit-liable"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"],
             ["apache-the", "apache-comply", "cddl-terms"], ["gpl-free", "gpl-hope", "gpl-see", "gpl-received", "agpl-free", "rights"]]
    texts = [full(*rnd.choices(rnd.choice(pools) + rnd.choice(pools), k=rnd.randint(1, 200))) for _ in range(60)]
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t)


def test_very_many_licence_lines(spark):
    """No recursion over identifiers: a grant before and after 200,000 notices."""
    notices = "Released under the MIT License.\nAll rights reserved.\n" * 100_000
    text = full("mit-grant") + "\n" + notices + full("mit-include", "as-is", "mit-liable", "bsd-grant")
    r = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_known == 200_005 and r.licenses == "MIT,proprietary" and r.sentence_ids.endswith("mit-liable,bsd-grant")


def test_tables_are_sound():
    assert all(len(set(rule)) == len(rule) for _, rule in L.RULES)
    assert len(set(L.SENTENCES.values())) == len(L.SENTENCES)
    assert all(i in L.SENTENCES for _, rule in L.RULES for i in rule)
    for s in L.SENTENCES.values():
        assert brute(s)[1] == 1, s


def test_native_plan(spark, sf_dir):
    plan = QUERIES["op3_license_scans"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


MIT = """MIT License

Copyright (c) 2020 A. Nother

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
AGPL = GPL3.replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU Affero\nGeneral")
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
CDDL = """The contents of this file are subject to the terms of the
Common Development and Distribution License (the "License").
You may not use this file except in compliance with the License."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
GENUINE = [
    (AGPL, "agpl-free,gpl-hope,agpl-see,agpl-received", "AGPL-3.0-or-later"),
    (LGPL21, "lgpl21-free,lgpl-hope,lgpl-see", "LGPL-2.1-or-later"),
    (EPL, "epl2-terms", "EPL-2.0"),
    (CDDL, "cddl-terms,apache-comply", "CDDL-1.0"),
    (ZLIB, "zlib-as-is,zlib-liable,zlib-grant", "Zlib"),
    (BOOST, "boost-grant", "BSL-1.0"),
    (MIT, "mit-grant,mit-include,as-is,mit-liable", "MIT"),
    (BSD, "bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause"),
    (BSD3, "bsd-grant,bsd-source,bsd-binary,bsd-name", "BSD-3-Clause"),
    (APACHE, "apache-the,apache-comply,apache-copy,apache-basis,apache-see", "Apache-2.0"),
    (GPL3, "gpl-free,gpl-hope,gpl-see,gpl-received", "GPL-3.0-or-later"),
    (GPL2, "gpl2-free", "GPL-2.0-or-later"),
    (MPL, "mpl-form,mpl-copy", "MPL-2.0"),
    (MPL.replace("http:", "https:"), "mpl-form,mpl-copy-https", "MPL-2.0"),
    (ISC, "isc-grant", "ISC"),
]


def test_genuine_wrapped_texts(spark):
    """As files, on one line, rewrapped, with Windows line ends, and under the comment marks of many languages."""
    rows = []
    for text, ids, name in GENUINE:
        lines = text.split("\n")
        forms = [text, " ".join(text.split()), "\n".join(text.split()), "\r\n".join(lines), f"/*\n{text}\n*/\nint x;"]
        forms += ["\n".join(mark + x for x in lines)
                  for mark in (" * ", "# ", "// ", "-- ", ";; ", "% ", "! ", "dnl ", "REM ", '.\\" ', "> ")]
        if text in (MIT, APACHE):  # on one line, title and owner run into the grant, and the address into the next sentence
            del forms[1]
        rows += [(f, ids, name) for f in forms]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    for i, (text, ids, name) in enumerate(rows):
        assert (got[i].sentence_ids, got[i].licenses) == (ids, name), text
        assert got[i].n_known <= got[i].n_sentences


def test_sentences_in_pieces_need_their_words(spark):
    """No match over missing or added words, and long runs of comment lines are no burden."""
    rows = [GPL2.replace("either", ""), MPL.replace("v. 2.0", "v. 1.1"), MIT.replace("\nfurnished", "\nnot furnished"),
            "# \n" * 100000 + "# Released under\n" + "# \n" * 100000 + "# the MIT License."]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in L.scan(df).collect()}
    assert got == {0: ("", ""), 1: ("mpl-copy", ""), 2: ("mit-include,as-is,mit-liable", ""), 3: ("mit-notice", "MIT")}
