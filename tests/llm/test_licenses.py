import random

import pytest

from larder.llm.licenses import TEMPLATES, Scanner, different_words, scan_licenses, words_of


@pytest.mark.parametrize("name, text", [t[:2] for t in TEMPLATES])
def test_every_template_is_found_in_other_words(name, text):
    scanner = Scanner()
    assert scanner.scan(text)[0] == name
    assert scanner.scan(f"Copyright 2020 some people. {text.upper()} All else follows below.")[0] == name


def test_other_wordings_are_not_confirmed():
    scanner = Scanner()
    for text in ("", "!!", "a driving license from the state", "The license was hard to read under the lamp", "Licensed under the Foo License, Version 2.0."):
        assert scanner.scan(text) is None
    assert scanner.scan("Licensed under CC BY-SA 4.0.")[0] == "CC-BY-SA-4.0" and scanner.scan("Licensed under CC BY 4.0.")[0] == "CC-BY-4.0"


@pytest.mark.parametrize("name, notice", [("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("Apache-2.0", "the Apache License, Version 2.0")])
def test_the_right_template_need_not_be_ranked_first(name, notice):
    assert Scanner().scan(f"This work is licensed under {notice}.")[0] == name


def test_every_notice_of_a_block(spark):
    both = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    rows = [(1, both), (2, f"{both} {both}"), (3, f"x {TEMPLATES[1][1]} y {TEMPLATES[8][1]}")]
    got = sorted((r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "Apache-2.0"), (1, "MIT"), (2, "Apache-2.0"), (2, "Apache-2.0"), (2, "MIT"), (2, "MIT"), (3, "Apache-2.0"), (3, "CC0-1.0")]


def test_notices_over_several_lines(spark):
    mit, mpl, cc = TEMPLATES[14][1], TEMPLATES[15][1], TEMPLATES[5][1]
    wrap = lambda text, at: text.replace(f"{at} ", f"{at}\n# ")
    rows = [(1, "code\n\n" + wrap(mit, "copy")), (2, "# " + wrap(mpl, "Public")), (3, "x\n" + wrap(cc, "Commons")), (4, "word " * 55 + mit + " word" * 300 + "\n" + wrap(wrap(mpl, "Source"), "the"))]
    got = sorted((r.doc_id, r.line, r.license, r.different) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, "MIT", 0), (2, 0, "MPL-2.0", 0), (3, 1, "CC-BY-4.0", 0), (4, 0, "MIT", 0), (4, 1, "MPL-2.0", 0)]


def test_notices_at_every_place_of_a_window():
    scanner = Scanner()
    for before in range(0, 200, 3):
        text = "word\n" * before + TEMPLATES[14][1].replace(" ", "\n") + "\nword" * 150
        assert [(n[0], n[3], n[6]) for n in scanner.notices(text)] == [(before, "MIT", 0)]


def test_a_long_template_without_a_usual_word(spark):
    terms = " ".join(f"term{i}" for i in range(500))
    own = (("Own", f"{terms} frobnication", ("frobnication",)),)
    texts = [terms.replace(" ", "\n") + "\nfrobnication", "a b\n" * 700 + f"{terms} frobnication", terms]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=own).collect()
    assert sorted((r.doc_id, r.line, r.license, r.different) for r in got) == [(0, 0, "Own", 0), (1, 700, "Own", 0)]


def test_different_words():
    a = words_of("released under the mit license")
    assert different_words(a, a) == 0
    assert different_words(a, words_of("x released under the old mit license y")) == 1
    assert different_words(a, words_of("released under the license")) == 1
    assert different_words(a, words_of("nothing")) == 5


def test_every_line_of_the_given_documents(spark):
    """Brute force: the lines that hold one of the notices as it stands."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id, r.line, r.license) for r in scan_licenses(docs).collect())
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        for i, line in enumerate((text or "").split("\n")):
            want += [(doc_id, i, name) for name in sorted({n for n, t, _ in TEMPLATES if t in line})]
    assert got == sorted(want) and got


def test_rows_of_every_kind(spark):
    notice = "Released under the MIT License."
    rows = [(1, notice, 1), (1, notice, 1), (None, f"x\n\n{notice}", None), (2, None, 1), (3, "", 1), (4, "word " * 100_000 + notice + " word" * 500, 1)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license int")).collect()
    found = {(r.doc_id, r.line, r.license) for r in got}
    assert found == {(1, 0, "MIT"), (None, 2, "MIT"), (4, 0, "MIT")} and sum(r.doc_id == 1 for r in got) == 2
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _reworded(text, draw, share=0.05):
    """A text with some of its words replaced, wrapped and commented as in a source file."""
    words = text.split()
    for i in draw.sample(range(4, len(words)), int(share * len(words))):
        if not any(mark in words[i].lower() for t in TEMPLATES if t[1] == text for mark in t[2]):
            words[i] = "otherwise"
    return "/*\n * " + "\n * ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n */\nint main() {}\n"


@pytest.mark.parametrize("number", [i for i, t in enumerate(TEMPLATES) if len(t[1].split()) >= 20])
def test_headers_and_whole_texts_wrapped_and_reworded(number):
    name, text, _ = TEMPLATES[number]
    scanner, draw = Scanner(), random.Random(number)
    for share in (0, 0.05):
        found = [n[3] for n in scanner.notices("Copyright (c) 2020 the authors\n" + _reworded(text, draw, share) + "x y z\n" * 50)]
        assert found == [name], (share, found)


def test_wordings_of_source_headers():
    """Headers as files carry them, none of them a template as it stands."""
    texts = {
        "MIT": "// SPDX-License-Identifier: MIT\npackage main",
        "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0",
        "GPL-3.0-or-later": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n",
        "GPL-2.0-or-later": " * This file is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by the\n * Free Software Foundation; either version 2 of the License, or (at your\n * option) any later version.",
        "LGPL-2.1-or-later": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.",
        "AGPL-3.0-or-later": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.",
        "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright\n   notice, this list of conditions and the following disclaimer in the\n   documentation and/or other materials provided with the distribution.\n3. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.",
        "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */",
    }
    scanner = Scanner()
    for name, text in texts.items():
        assert [n[3] for n in scanner.notices(text)] == [name]
    assert [n[3] for n in scanner.notices("This project is licensed under the MIT license.")] == ["MIT"]
    assert [n[3] for n in scanner.notices(" .\n".join(texts.values()))] == list(texts)


class _Blind:
    """A compressor to which everything is the same size."""

    def compress(self, data):
        return b"x" * 100


def test_nothing_is_found_without_compression():
    scanner = Scanner()
    assert all(scanner.scan(t[1]) for t in TEMPLATES)
    scanner._plain = _Blind()
    scanner._templates = [t._replace(coder=_Blind()) for t in scanner._templates]
    assert not any(scanner.scan(t[1]) for t in TEMPLATES)


def test_each_template_is_compressed_with_a_candidate_block():
    scanner, seen = Scanner(), []

    class Counting:
        def __init__(self, number, coder):
            self.number, self.coder = number, coder

        def compress(self, data):
            seen.append(self.number)
            return self.coder.compress(data)

    scanner._templates = [t._replace(coder=Counting(i, t.coder)) for i, t in enumerate(scanner._templates)]
    scanner.scan("Licensed under CC BY 4.0.")
    assert {i for i, t in enumerate(scanner._templates) if t.window == 64} <= set(seen)


def test_the_size_reduction_decides_between_overlapping_matches():
    lesser = next(t for t in TEMPLATES if t[0] == "LGPL-3.0-or-later" and "program" in t[1])[1]
    scanner, words = Scanner(), words_of(lesser)
    names = {scanner._templates[m.template].name for m in scanner.matches(words, [0] * len(words))}
    assert {"GPL-3.0-or-later", "LGPL-3.0-or-later"} <= names  # both wordings are near enough
    assert [f[0] for f in scanner.scan_all(lesser)] == ["LGPL-3.0-or-later"]
