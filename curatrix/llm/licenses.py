"""License notices in texts, recognised by how well a template compresses them."""

from __future__ import annotations

import difflib
import re

import zstandard
from pyspark.sql import DataFrame

from .common import id_and_text, map_texts

#: Share of a template's words that may be worded differently.
DIFFERENCES = 0.06
#: Best compressing templates of a block that are compared word by word.
RANKED = 3
WORD = re.compile(r"[^\W_]+(?:[.\-/'’][^\W_]+)*")
#: Every template has more of these stems than it may have differences, so that a match holds one at least.
STEMS = ("licen", "copyright", "software", "permission", "warrant", "redistribut", "domain", "mozilla", "mpl")

_WARRANTY_MIT = """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be
liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection
with the software or the use or other dealings in the software."""
_CONDITIONS_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_WARRANTY_BSD = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including,
but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free
Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU
{0} for more details."""

# Wordings of license notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. """ + _WARRANTY_MIT),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all
warranties with regard to this software including all implied warranties of merchantability and fitness."""),
    ("BSD-2-Clause", _CONDITIONS_BSD + " " + _WARRANTY_BSD),
    ("BSD-3-Clause", _CONDITIONS_BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. """ + _WARRANTY_BSD),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose."""),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


class LicenseScanner:
    """Templates with their word n-grams and compressors."""

    def __init__(self, templates=TEMPLATES, differences: float = DIFFERENCES):
        self.names = [name for name, _ in templates]
        self.words = [[w.lower() for w in WORD.findall(text)] for _, text in templates]
        self.allowed = [int(differences * len(w)) for w in self.words]
        texts = [" ".join(w).encode() for w in self.words]
        plain = zstandard.ZstdCompressor(level=3)
        self.plain = plain.compress
        self.with_template = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress for t in texts
        ]
        self.grams: dict[tuple, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for i in range(len(words) - 2):
                self.grams.setdefault(tuple(words[i : i + 3]), []).append((k, i))

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """Stretches of words that a template may cover: around its three-word runs, at its length.

        A match has a run of three unchanged words, as more than a tenth of a template's
        words would have to differ otherwise; the run's place in the template gives the
        stretch, with room for the words that may differ.
        """
        found = set()
        for i in range(len(words) - 2):
            for k, at in self.grams.get((words[i], words[i + 1], words[i + 2]), ()):
                room = self.allowed[k]
                found.add((max(0, i - at - room), min(len(words), i - at + len(self.words[k]) + room)))
        return sorted(found)

    def differences(self, k: int, words: list[str]) -> tuple[int, int, int, list[str]]:
        """(changed words, first, last, wordings) of template ``k`` in a block; words around it do not count."""
        template = self.words[k]
        codes = difflib.SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
        if codes[0][0] == "insert":
            codes = codes[1:]
        if codes and codes[-1][0] == "insert":
            codes = codes[:-1]
        changed, wordings = 0, []
        for kind, a, b, c, d in codes:
            if kind != "equal":
                changed += max(b - a, d - c)
                wordings.append(f"{' '.join(template[a:b])} > {' '.join(words[c:d])}")
        return changed, (codes[0][3] if codes else 0), (codes[-1][4] if codes else 0), wordings

    def scan(self, text: str | None) -> list[dict]:
        """Matches in a whole text, without overlap: more of the text first, then fewer differences, then better compression."""
        low = (text or "").lower()
        if not any(s in low for s in STEMS):
            return []
        places = [(m.group(), *m.span()) for m in WORD.finditer(low)]
        words = [p[0] for p in places]
        found, seen = [], {}
        for first, last in self.blocks(words):
            block = words[first:last]
            key = tuple(block)
            if key not in seen:
                data = " ".join(block).encode("utf-8", "surrogatepass")
                size = len(self.plain(data))
                gains = sorted(((1 - len(c(data)) / size, -k) for k, c in enumerate(self.with_template)), reverse=True)
                won = [(g, -k, *self.differences(-k, block)) for g, k in gains[:RANKED] if g > 0]
                seen[key] = [w for w in won if w[2] <= self.allowed[w[1]]]
            for gain, k, changed, a, b, wordings in seen[key]:
                found.append((a - b, changed, -gain, first + a, first + b, k, wordings))
        out, taken = [], []
        for _, changed, loss, a, b, k, wordings in sorted(found, key=lambda f: f[:6]):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append({"license": self.names[k], "start": places[a][1], "end": places[b - 1][2], "reduction": round(-loss, 6), "differences": changed, "wording": wordings})
        return sorted(out, key=lambda m: m["start"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, differences: float = DIFFERENCES) -> DataFrame:
    """``doc_id``, ``n_matches``, ``licenses`` (distinct, sorted, joined by commas) and ``matches`` of each whole text.

    Blocks around runs of template words are compressed alone and with each template as a
    raw dictionary. The templates that shorten a block most are compared with it word by
    word; a match has at most ``differences`` of the template's words worded otherwise
    (none in short notices). ``matches`` has license, place in the lower-cased text, size
    reduction, number of differences and their wordings.

    * Null, empty and unlicensed texts have no match, an empty string and an empty list.
    * Notices that repeat are separate matches. Repeated rows and null ids pass through.
    """

    def prepare():
        scanner = LicenseScanner(templates, differences)

        def work(texts: list) -> dict:
            rows = [scanner.scan(t) for t in texts]
            return {"n_matches": [len(r) for r in rows], "licenses": [",".join(sorted({m["license"] for m in r})) for r in rows], "matches": rows}

        return work

    fields = "license:string,start:long,end:long,reduction:double,differences:int,wording:array<string>"
    return map_texts(id_and_text(docs, id_col, text_col), prepare, f"n_matches int, licenses string, matches array<struct<{fields}>>")
