"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pricelode.llm.corpus import texts

_GNU = (
    "This {kind} is free software: you can redistribute it and/or modify it under the terms of the {{GNU {name}}} as "
    "published by the Free Software Foundation, either {{version {version} of the License}}, or (at your option) any later "
    "version.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must {retain the above copyright notice}, this list of "
    "conditions and the following disclaimer.")
_BINARY = (
    " Redistributions in {binary form must reproduce} the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the ")

# The notices of public licenses. Phrases in braces tell a license from others and have to be there as they are.
TEMPLATES = {
    "MIT-notice": "Released under the {MIT License}.",
    "Apache-2.0-notice": "Licensed under the {Apache License, Version 2.0}.",
    "GPL-3.0-notice": "This work is licensed under the {GNU General Public License, version 3}.",
    "CC-BY-NC-4.0-notice": "Licensed under {CC BY-NC 4.0}.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and {this permission notice shall be included} in all copies or substantial portions of the Software."),
    "MIT-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished {to do so. The software is provided} \"as is\""),
    "Apache-2.0": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/{licenses/LICENSE-2.0} Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    **{f"{short}-{version if '.' in version else version + '.0'}": _GNU.format(
        kind="program" if short in ("GPL", "AGPL") else "library", name=name, version=version)
       for short, name, version in (
           ("GPL", "General Public License", "1"), ("GPL", "General Public License", "2"), ("GPL", "General Public License", "3"),
           ("LGPL", "Library General Public License", "2"), ("LGPL", "Lesser General Public License", "2.1"),
           ("LGPL", "Lesser General Public License", "3"), ("AGPL", "Affero General Public License", "3"))},
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "MPL-1.1": (
        "The contents of this file are subject to the {Mozilla Public License Version 1.1} (the \"License\"); you may not use this "
        "file except in compliance with the License."),
    "BSD": _BSD,
    "BSD-2-Clause": _BSD + _BINARY + "{distribution. This software is provided}",
    "BSD-3-Clause": _BSD + _BINARY + (
        "distribution. {Neither the name} of the copyright holder nor the names of its contributors may be used to {endorse or "
        "promote products} derived from this software without specific prior written permission. This software is provided"),
    "BSD-4-Clause": _BSD + _BINARY + (
        "distribution. {All advertising materials mentioning} features or use of this software must display the following "
        "acknowledgement"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "{granted, provided that the above copyright notice} and this permission notice appear in all copies."),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "{granted. The software is provided} \"as is\""),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
        "it and redistribute it freely, subject to the following restrictions: The {origin of this software must not be "
        "misrepresented}; you must not claim that you wrote the original software."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare {derivative works of the Software}"),
    "Unlicense": (
        "This is free and unencumbered software {released into the public domain}. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."),
}


def _names() -> dict[str, list[str]]:
    """The names of licenses, by what they are reported as; a name without a version stands for any version."""
    out = {
        "MIT": ["MIT License", "MIT licence"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License"],
        "Unlicense": ["Unlicense"], "BSD": ["BSD License"], "CC0-1.0": ["CC0 1.0", "CC0", "CC0-1.0"],
        "Apache": ["Apache License"], "Apache-1.1": ["Apache License, Version 1.1", "Apache License 1.1", "Apache-1.1"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License Version 2",
                       "Apache 2.0 License", "Apache-2.0"],
        "MPL": ["Mozilla Public License"], "EPL": ["Eclipse Public License"], "Artistic-2.0": ["Artistic License 2.0"],
    }
    for n, word in (("2", "two"), ("3", "three"), ("4", "four")):
        out[f"BSD-{n}-Clause"] = [f"BSD {n}-Clause License", f"{n}-Clause BSD License", f"BSD-{n}-Clause", f"{word}-clause BSD License"]
    versions = (
        ("GPL", "GNU General Public License", "1 2 3"), ("LGPL", "GNU Lesser General Public License", "2.1 3"),
        ("LGPL", "GNU Library General Public License", "2"), ("AGPL", "GNU Affero General Public License", "3"),
        ("MPL", "Mozilla Public License", "1.0 1.1 2.0"), ("EPL", "Eclipse Public License", "1.0 2.0"))
    for short, name, known in versions:
        if name not in out.setdefault(short, []):
            out[short].append(name)
        for version in known.split():
            full = version if "." in version else f"{version}.0"
            forms = [f"{name}{mark}{v}" for v in {version: 0, full: 0} for mark in (", version ", " v", " ")]
            out.setdefault(f"{short}-{full}", []).extend([*forms, f"{short}-{full}", f"{short}v{version}", f"{short} v{version}"])
    words_of = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        long = "-".join(words_of[k] for k in kind.split("-"))
        for version in ("", "1.0", "2.0", "2.5", "3.0", "4.0"):
            tail, dash = (f" {version}", f"-{version}") if version else ("", "")
            out[f"CC-{kind.upper()}{dash}"] = list(dict.fromkeys(
                [f"CC {kind}{tail}", f"CC-{kind}{dash}", f"CC-{kind}{tail}", f"CC {kind.replace('-', ' ')}{tail}",
                 f"Creative Commons {long}{tail}", f"Creative Commons {long.replace('-', ' ')}{tail}"]))
    return out


def _notices() -> list[tuple[str, str]]:
    """``(reported as, wording)``. A wording of fewer than five words allows no other word at 0.8, so the usual ones are listed."""
    out = []
    for kind, names in _names().items():
        for name in names:
            bare = "licen" not in name.lower()
            for the in ("", "the ")[not bare:1 if name.startswith(("CC", "Creative")) else 2]:
                short = len(words(the + name)) < 3
                out += [(f"{kind}-notice", f"{verb} under {the}{{{name}}}")
                        for verb in (("licensed", "released", "distributed", "available", "published") if short else ("licensed",))]
    return out


_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
_PHRASE = re.compile(r"\{([^{}]*)\}")
_SCHEMA = "doc_id long, license string, coverage double, matched int, template_words int, first_word long, last_word long"


def words(text: str) -> list[str]:
    """Words in lower case; points and hyphens inside a word belong to it."""
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    piles: list[int] = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before[i] = piles[at - 1] if at else -1
        piles[at:at + 1], tops[at:at + 1] = [i], [v]
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, in order in both: the anchors of each gap, then the gaps between them."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if in_text[w] == 1 == in_template.get(w, 0)}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if w in place]
        chain = [anchors[i] for i in increasing([x for x, _ in anchors])]
        if not chain:  # no word is unique to both: the first common one, so that repeated words count too
            common = next(((text.index(w, a, b), j) for j, w in enumerate(template[c:d], c) if w in in_text), None)
            if common is None:
                continue
            out.append(common)
            gaps.append((common[0] + 1, b, common[1] + 1, d))
            continue
        out += chain
        for (x, y), (x2, y2) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            gaps.append((x + 1, x2, y + 1, y2))
    return sorted(out)


class Scanner:
    """Finds wordings, ``(license, text)``, in texts."""

    def __init__(self, wordings: list[tuple[str, str]], least: float):
        self.least = least
        self.by_word: dict[str | None, list[tuple]] = {}  # by the first word that a text has to have
        self.vocabulary: set[str] = set()
        for name, text in wordings:
            if template := words(text):
                phrases = required(text)
                key = phrases[0][1][0] if phrases else None
                self.by_word.setdefault(key, []).append((name, template, Counter(template), phrases))
                self.vocabulary.update(template)

    def find(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """``(license, coverage, matched, template words, first word, last word)`` for each place that has a template."""
        found = words(text)
        at: dict[str, list[int]] = {}
        for i, w in enumerate(found):
            if w in self.vocabulary:
                at.setdefault(w, []).append(i)
        if not at:
            return []
        seen: dict[tuple[str, ...], list[int]] = {}

        def occurrences(phrase: tuple[str, ...]) -> list[int]:
            if phrase not in seen:
                seen[phrase] = [i for i in at.get(phrase[0], ()) if tuple(found[i:i + len(phrase)]) == phrase]
            return seen[phrase]

        hits = []
        for name, template, own, phrases in (t for key, some in self.by_word.items() if key is None or key in at for t in some):
            if not all(occurrences(phrase) for _, phrase in phrases):
                continue
            need = self.least * len(template)
            if sum(min(n, len(at.get(w, ()))) for w, n in own.items()) < need:  # coverage can't reach the limit anywhere
                continue
            places = sorted(i for w in own for i in at.get(w, ()))
            width, start = len(template) + len(template) // 2 + 2, 0
            while start < len(places):
                first = places[start]
                if phrases:  # the window has to hold the first phrase
                    spots = occurrences(phrases[0][1])
                    nearest = bisect_left(spots, first)
                    if nearest == len(spots):
                        break
                    if spots[nearest] >= first + width:
                        start = bisect_left(places, spots[nearest] - width + 1)
                        continue
                end = bisect_left(places, first + width)
                if end - start >= need:
                    pairs = aligned(found[first:first + width], template)
                    if pairs and len(pairs) >= need and pairs[0][0] == 0 and (marks := _marks(pairs, phrases)):
                        last = first + pairs[-1][0]
                        hits.append((-len(marks), -len(pairs), -len(pairs) / len(template), first, last, name, len(template),
                                     {first + x for x in marks}))
                        start = bisect_left(places, last + 1)
                        continue
                start += 1
        taken: set[int] = set()
        out = []
        for _, matched, coverage, first, last, name, length, marks in sorted(hits, key=lambda h: h[:6]):
            if not marks & taken:
                taken |= marks
                out.append((name, -coverage, -matched, length, first, last))
        return sorted(out, key=lambda h: (h[4], h[5], h[0]))


def required(template: str) -> list[tuple[int, tuple[str, ...]]]:
    """The phrases in braces, with the place of their first word."""
    return [(len(words(template[:m.start()])), tuple(w)) for m in _PHRASE.finditer(template) if (w := words(m.group(1)))]


def _marks(pairs: list[tuple[int, int]], phrases: list[tuple[int, tuple[str, ...]]]) -> set[int]:
    """Places of the words that tell the license: all aligned ones if no phrase is required, none if a phrase is not aligned as it is."""
    if not phrases:
        return {x for x, _ in pairs}
    place = {y: x for x, y in pairs}
    out: set[int] = set()
    for start, phrase in phrases:
        if start not in place or any(place.get(start + k) != place[start] + k for k in range(len(phrase))):
            return set()
        out.update(range(place[start], place[start] + len(phrase)))
    return out


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
            least: float = 0.8) -> DataFrame:
    """``(doc_id, license, coverage, matched, template_words, first_word, last_word)``: one row per place of a license.

    A place starts with an aligned word, is at most half as long again as the template, and has at least ``least`` of its
    words, in order, among them every phrase in braces, word by word. Places of one wording don't overlap. Where places share
    words that tell the license (those in braces; all, if there are none), the one with most such words stays, then with most
    aligned words, then the best covered. A license that is not listed gives no row, or that of its family without a version. Null and empty texts, and texts without a license, give no rows; rows without
    an id or that repeat are scanned like any other. An empty table gives no rows; other columns are ignored. Row-local: no
    shuffle. The templates go to every task; they are meant to be hundreds at most.
    """
    wordings = [*TEMPLATES.items(), *_notices()] if templates is None else list(templates.items())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wordings, least)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for hit in scanner.find(text or "")]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             [f.split()[0] for f in _SCHEMA.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(scan, _SCHEMA)
