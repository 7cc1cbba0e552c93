from __future__ import annotations

import random

import pytest

from larkspur.llm import licenses as L

FILES = [
    (1, "a/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (2, "a/b/c.txt", "some words here"), (3, "a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."), (4, "a/b/d/e.txt", None), (5, "a/x.txt", ""),
    (6, "z.txt", "nothing"), (7, None, "nothing"), (8, "a/own.c", "// This work is licensed under the GNU General Public License, version 3.\ncode " + "x " * 300),
    (9, "q/r.txt", "word " * 50_000 + "Released under the MIT License. " + "word " * 100), (9, "q/r.txt", "again, licensed"), (10, "ab/c.txt", "ab is not below a"),
]


def test_scan_and_inheritance(spark):
    df = spark.createDataFrame([(*f, "x", "y") for f in FILES], "id long, path string, text string, license string, dir string").repartition(3)
    got = sorted(((r.id, r.license, r.origin, r.inherited_from) for r in L.licensed_files(df).collect()), key=str)
    want = [
        (1, "MIT", "own", None), (2, "Apache-2.0", "inherited", "a/b"), (3, "Apache-2.0", "own", None), (4, "Apache-2.0", "inherited", "a/b"), (5, "MIT", "inherited", "a"), (6, None, None, None), (7, None, None, None),
        (8, "GPL-3.0", "own", None), (9, "MIT", "own", None), (9, None, None, None), (10, None, None, None),
    ]
    assert got == sorted(want, key=str)
    assert L.licensed_files(df.limit(0)).count() == 0


def test_root_licence(spark):
    df = spark.createDataFrame([(1, "COPYING", "Licensed under CC BY-NC 4.0."), (2, "d/e/f", "x"), (3, "g", "x"), (4, None, "x")], "id long, path string, text string")
    assert {r.id: (r.license, r.inherited_from) for r in L.licensed_files(df).collect()} == {1: ("CC-BY-NC-4.0", None), 2: ("CC-BY-NC-4.0", ""), 3: ("CC-BY-NC-4.0", ""), 4: ("CC-BY-NC-4.0", "")}


def test_every_template_finds_itself():
    s = L.Scanner(1000, {"the": 900, "under": 400})
    for name, texts in L.TEMPLATES.items():
        for t in texts:
            assert s.scan("Some words before it. " + t + "; and words after.")[0].license == name
    assert s.scan("the licence of poets and the licensed trade") == []


def test_cosine_equals_dense():
    import math
    from collections import Counter

    s = L.Scanner(50, {"license": 3})
    words = L.terms("Released under some MIT License today")
    for i, (_, t, _) in enumerate(L._TEMPLATES):
        idf = lambda w: s.idf.get(w, s.other)
        a, b = Counter(words), Counter(t)
        dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a)
        size = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))
        assert abs(s.cosine(words, i) - dot / size(a) / size(b)) < 1e-12


def plain_scan(scanner, text):
    """Every place and template, with dense vectors: the licences of passages that don't overlap, most evidence first."""
    words, found = L.terms(text), []
    for i, (name, t, _) in enumerate(L._TEMPLATES):
        anchors = [o for o, w in enumerate(t) if w.startswith("licen") or w in L.CUES][: L.ANCHORS]
        for at in range(-len(t), len(words)):
            if any(0 <= at + o < len(words) and words[at + o] == t[o] for o in anchors):
                part = words[max(0, at) : at + len(t)]
                if scanner.cosine(part, i) >= L.SIMILAR:
                    fits = scanner.fits(words, max(0, at), i)
                    weight = sum((2 * min(t.count(w), part.count(w)) - t.count(w)) * scanner.idf[w] for w in set(t))
                    found.append((not fits, -round(weight, 6), max(0, at), -len(t), name))
    out = []
    for x in sorted(set(found)):
        if all(x[2] - x[3] <= y[2] or y[2] - y[3] <= x[2] for y in out):
            out.append(x)
    return ["unknown" if x[0] else x[4] for x in out]


def test_scan_equals_all_places():
    s = L.Scanner(5000, {"the": 4000, "under": 2000, "license": 90, "version": 300})
    notices = [t for ts in L.TEMPLATES.values() for t in ts]
    rng = random.Random(4)
    for n in range(60):
        parts = [rng.choice(notices) for _ in range(rng.randrange(3))]
        words = " ".join("some words " * rng.randrange(4) + p for p in parts).split() + ["end"]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = rng.choice(["license", "x", "permission", "the"])
        text = " ".join(words)
        assert [h.license for h in s.scan(text)] == plain_scan(s, text), n


#: Licence files as their projects ship them, shortened where they are long, with holders and years.
REAL = {
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n  The licenses for most software and other practical works are designed\nto take away your freedom to share and change the works.",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nPreamble\n\nThe GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.\n\nThe licenses for most software and other practical works are designed to take away your freedom",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nThis version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.\n\n0. Additional Definitions.",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nCopyright (C) 1991, 1999 Free Software Foundation, Inc.\n51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\n[This is the first released version of the Lesser GPL.  It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.]\n\nPreamble",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.,\n51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nPreamble\n\nThe licenses for most software are designed to take away your freedom to share and change it.  By contrast,",
    "MIT": "MIT License\n\nCopyright (c) 2019 Ann Example\n\n" + L.TEXTS["MIT"][0],
    "BSD-2-Clause": "Copyright (c) 2003, Ann Example\nAll rights reserved.\n\n" + L.TEXTS["BSD-2-Clause"][0],
    "BSD-3-Clause": "Copyright (c) The Regents of the University of California.\nAll rights reserved.\n\n" + L.TEXTS["BSD-3-Clause"][0].replace("the copyright holder nor", "the University nor").replace("copyright holders and", "Regents and"),
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n\n1.2. \"Contributor Version\"\n    means the combination of the Contributions of others (if any) used\n    by a Contributor and that particular Contributor's Contribution.\n\n1.3. \"Contribution\"",
    "GPL-2.0-or-later": "/* tool.c\n\n   This program is free software; you can redistribute it and/or modify\n   it under the terms of the GNU General Public License as published by\n   the Free Software Foundation; either version 2 of the License, or\n   (at your option) any later version.\n\n   This program is distributed in the hope that it will be useful */ int main() { return 0; }",
    "GPL-2.0-only": "/* This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License. */ int x;",
    "GPL-3.0-or-later": "# This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nimport os",
    "ISC": "Copyright (c) 4-digit year, Company or Person's Name\n\n" + L.TEXTS["ISC"][0],
    "Zlib": "(C) 1995-2022 Ann Example\n\n" + L.TEXTS["Zlib"][0],
    "Unlicense": L.TEXTS["Unlicense"][0] + " We make this dedication for the benefit of the public at large.",
    "EPL-2.0": "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION\n    OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.\n\n1. DEFINITIONS",
}


_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
#: Relatives that a cosine takes for each other, and what they are.
NEAR = {
    "MIT No Attribution\n\nCopyright 2021 Ann\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS: ["MIT-0"],
    "Copyright (C) 2020 by Ann <a@b.c>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.": ["0BSD"],
    _BSD_HEAD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University.\n4. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n": ["BSD-4-Clause"],
    _BSD_HEAD + "3. Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n": ["BSD-3-Clause"],
    _BSD_HEAD: ["BSD-2-Clause"],
    "// SPDX: BSD-4-Clause": ["BSD-4-Clause"],
    "SPDX-License-Identifier: GPL-1.0-or-later": ["GPL-1.0-or-later"],
    "# SPDX-License-Identifier: MIT OR Apache-2.0\nimport x": ["MIT", "Apache-2.0"],
    "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause */": ["GPL-2.0-only WITH Linux-syscall-note", "BSD-3-Clause"],
    "SPDX-License-Identifier: see the file beside": [],
    "This work is licensed under the GNU General Public License, version 1.": ["GPL-1.0"],
    "This work is licensed under the GNU General Public License, version 4.": ["unknown"],
    "licensed under a Creative Commons Attribution 3.0 Unported License": ["CC-BY-3.0"],
    "licensed under a Creative Commons Attribution 4.0 International License": ["CC-BY-4.0"],
    "Licensed under the Apache License, Version 1.1": ["unknown"],
    "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": ["unknown"],
    "Licensed under the Apple License, Version 2.0": ["unknown"],
    "Licensed under the EUPL, Version 1.2 only": ["EUPL-1.2"],
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/": ["MPL-1.1"],
    "The Artistic License 2.0\n\nCopyright (c) 2000-2006, The Perl Foundation.\n\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nPreamble\n\nThis license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package": ["Artistic-2.0"],
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.": ["WTFPL"],
}


@pytest.mark.parametrize("total", [3, 100_000])
@pytest.mark.parametrize("text", NEAR)
def test_relatives_are_told_apart(text, total):
    s = L.Scanner(total, {w: total for w in ("the", "of", "and", "to")} | ({"license": 2000, "software": 9000, "version": 5000} if total > 3 else {}))
    for shown in (text, "Some words. " * 30 + text + " more words" * 30):
        got = [h.license for h in s.scan(shown)]
        assert got == NEAR[text] or NEAR[text] == ["unknown"] and not got  # too unlike for a relative


@pytest.mark.parametrize("name", sorted(REAL))
@pytest.mark.parametrize("total", [3, 100_000])
def test_real_licences(name, total):
    """Whole files and headers, with few documents to weigh terms by and with many."""
    s = L.Scanner(total, {w: total for w in ("the", "of", "and", "to")} | ({"license": 2000, "software": 9000, "version": 5000} if total > 3 else {}))
    source = REAL[name].startswith(("/*", "#"))
    hits = s.scan(REAL[name] + "\nx = y + z" * 40 * source)
    assert hits[0].license == name
    assert L._role("some/dir/x.txt", hits[0]) == ("header" if source else "file")


def test_dual_notices_are_listed():
    s = L.Scanner(1000, {"the": 900})
    text = "Released under the MIT License. " + "words " * 30 + "Alternatively it is licensed under the GNU General Public License, version 2."
    assert sorted(h.license for h in s.scan(text)) == ["GPL-2.0", "MIT"]


def plain_inheritance(scan):
    """For each row the nearest directory above that has a licence file, looked for step by step."""
    from posixpath import dirname

    held = {}
    for path, name, similarity, role in sorted(((r[1] or "", r[2], r[3], r[4]) for r in scan if r[4] == "file"), key=lambda x: (-x[2], x[0], x[1])):
        held.setdefault(dirname(path), name)
    out = []
    for number, path, name, *_ in scan:
        at, given = dirname(path or ""), None
        while not name and given is None:
            given = (held[at], at) if at in held else None
            if not at:
                break
            at = dirname(at)
        out.append((number, name or (given[0] if given else None), "own" if name else "inherited" if given else None, given[1] if given else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_inheritance_equals_walking_up(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_ROWS", broadcast)
    rng, rows = random.Random(5), []
    for i in range(300):
        path = "/".join(rng.choice("ab") for _ in range(rng.randrange(5))) + "/"
        name = rng.choice(["LICENSE", "COPYING", "x.c", "y.md", "z"])
        rows.append((i, path.lstrip("/") + name, rng.choice([t[0] for t in L.NOTICES.values()]) if name.isupper() and rng.random() < 0.3 else "nothing here"))
    rows += [(1000, None, None), (1001, "LICENSE", "Released under the MIT License"), (1001, "LICENSE", "Released under the MIT License"), (1002, "a/COPYING", "Licensed under the Apache License, Version 2.0")]
    df = spark.createDataFrame(rows, "id long, path string, text string").repartition(3)
    scan = [tuple(r) for r in L.scan_files(df).collect()]
    got = sorted(((r.id, r.license, r.origin, r.inherited_from) for r in L.licensed_files(df).collect()), key=str)
    assert got == plain_inheritance(scan)
