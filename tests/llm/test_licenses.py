from __future__ import annotations

import random
from itertools import combinations

from pricelode.llm import licenses


def test_increasing_is_longest():
    r = random.Random(0)
    for _ in range(200):
        v = [r.randint(0, 9) for _ in range(r.randint(0, 8))]
        got = [v[i] for i in licenses.increasing(v)]
        best = max((len(c) for n in range(len(v) + 1) for c in combinations(v, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


def test_alignment_is_in_order_and_of_equal_words():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < x2 and y < y2 for (x, y), (x2, y2) in zip(got, got[1:]))
    assert len(licenses.aligned(list("abcabd"), list("abcabd"))) == 6


def test_finds_every_place_of_a_template(documents):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-notice"]
    changed = mit.replace("free of charge", "at no cost").replace("publish, ", "")
    filler = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, f"{filler}\n{changed}\n{filler}"), (2, f"{gpl} {gpl} {filler} {gpl.upper()}"), (3, filler), (4, None), (5, ""),
            (6, "the license of this work is public"), (None, gpl)]
    got = [tuple(r) for r in licenses.scanned(documents(rows)).collect()]
    assert [(r[0], r[1]) for r in got if r[0] == 1] == [(1, "MIT")]
    row = next(r for r in got if r[0] == 1)
    assert 0.9 < row[2] < 1 and row[5] == 3000 and row[3] == round(row[2] * row[4])
    assert [r[5:] for r in got if r[0] == 2] == [(0, 11), (12, 23), (3024, 3035)]
    assert sorted({r[0] for r in got}, key=str) == [1, 2, None]


def test_no_row_under_the_limit_and_own_templates(documents):
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta x gamma"), (3, "delta gamma beta alpha")]
    got = licenses.scanned(documents(rows), {"own": "alpha beta gamma delta", "empty": "..."}, least=0.75).collect()
    assert sorted((r["doc_id"], r["coverage"]) for r in got) == [(1, 1.0), (2, 0.75)]


NEAR = [
    ("Released under the MIT License.", ["MIT-notice"]),
    ("Released under the BSD License.", ["BSD-notice"]),
    ("Released under the Foo License.", []),
    ("Released under the BSD 3-Clause License.", ["BSD-3-Clause-notice"]),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0-notice"]),
    ("Released under CC BY-NC 3.0.", ["CC-BY-NC-3.0-notice"]),
    ("Licensed under CC BY NC 4.0.", ["CC-BY-NC-4.0-notice"]),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0-notice"]),
    ("Licensed under CC0.", ["CC0-1.0-notice"]),
    ("Licensed under GPLv2.", ["GPL-2.0-notice"]),
    ("Released under the LGPL-2.1.", ["LGPL-2.1-notice"]),
    ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1-notice"]),
    ("Available under the terms of the Apache License 2.0.", ["Apache-2.0-notice"]),
    ("Licensed under the MIT License or the Apache License, Version 2.0.", ["Apache-2.0-notice", "MIT-notice"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-notice"]),
    ("This work is licensed under the GNU General Public License.", ["GPL-notice"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-notice"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1-notice"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0-notice"]),
    ("Licensed under the Mozilla Public License, version 2.0.", ["MPL-2.0-notice"]),
]


def test_near_misses_are_told_apart():
    scanner = licenses.Scanner([*licenses.TEMPLATES.items(), *licenses._notices()], 0.8)
    for text, want in NEAR:
        assert sorted({h[0] for h in scanner.find(f"a b c. {text} d e f")}) == want, text


def test_every_template_is_found_as_itself(documents):
    names = list(licenses.TEMPLATES)
    got = licenses.scanned(documents([(i, licenses.TEMPLATES[n]) for i, n in enumerate(names)])).collect()
    assert {(i, n) for i, n in enumerate(names)} <= {(r["doc_id"], r["license"]) for r in got if r["coverage"] == 1}
    assert len(got) == len(names)


def test_places_with_the_same_phrase_keep_the_longest(documents):
    templates = {"short": "under the {blue license}", "long": "under the {blue license} two"}
    got = licenses.scanned(documents([(1, "under the blue license two"), (2, "under the light blue license two"),
                                      (3, "under the blue x license two")]), templates).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "long"), (2, "long")]


def test_empty_table(documents):
    assert licenses.scanned(documents([])).collect() == []
