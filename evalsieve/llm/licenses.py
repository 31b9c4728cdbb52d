"""License scans by conditional compression (operator 2).

A text is cut into segments at line ends and after sentence marks; runs of segments that hold a cue are the candidate
blocks. Cues are words of the templates themselves, so many of each that no text which keeps enough of a template is
without one. Each block is compressed by zstandard alone and with every template as raw dictionary, and goes to the template
that makes it smallest, if the exact wording confirms it: at least KEPT of the template's words in order, all numbers among
them, and short templates in one piece. Else the next one in the ranking is held against it. A winner's words are taken out,
and the rest is compressed with all templates again, so that neighbouring notices each get a row. Blocks are looked up by
their words, so a notice that many documents share is compressed once per task.

Defined results: null text counts as empty; texts without a confirmed block have no rows. Repeated rows give repeated
rows. Texts of any length are scanned whole; an empty table gives an empty result. Of templates that make a block equally
small the first by name comes first; a block names a license once. Columns besides id and text are not read.
"""

from __future__ import annotations

import collections
import re
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_or_empty

KEPT, SHORT, MEMO = 0.85, 3, 100_000

# The notices looked for.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "ISC": "Released under the ISC License.",
    "EPL-2.0": "This program is made available under the terms of the Eclipse Public License 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "Proprietary": "All rights reserved.",
}

# Further wordings: SPDX identifiers, the licenses' own headers, and the short licenses in full.
SPDX = {
    **{k: [k] for k in ("MIT", "Apache-2.0", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0")},
    **{k: [k, f"{k}-only", f"{k}-or-later"] for k in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0")},
}
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
FORMS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-2.0": [GNU.format("", 2)],
    "GPL-3.0": [GNU.format("", 3)],
    "LGPL-3.0": [GNU.format("Lesser ", 3)],
    "AGPL-3.0": [GNU.format("Affero ", 3)],
    "MPL-2.0": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": [BSD + NAMES],
    "BSD-2-Clause": [BSD],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": [CC.format("")],
    "CC-BY-SA-4.0": [CC.format("-ShareAlike")],
    "CC-BY-NC-4.0": [CC.format("-NonCommercial")],
    "CC-BY-ND-4.0": [CC.format("-NoDerivatives")],
}
#: short notices: what a license is called, and how it is said
NAMES_OF = {
    "MIT": ["MIT"], "ISC": ["ISC"], "Unlicense": ["Unlicense"], "Apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache-2.0"], "BSD-3-Clause": ["BSD 3-Clause", "BSD-3-Clause"], "BSD-2-Clause": ["BSD 2-Clause", "BSD-2-Clause"],
    "GPL-2.0": ["GNU GPL v2", "GPL v2", "GPLv2", "GPL-2.0"], "GPL-3.0": ["GNU GPL v3", "GPL v3", "GPLv3", "GPL-3.0"], "LGPL-3.0": ["GNU LGPL v3", "LGPL v3", "LGPLv3", "LGPL-3.0"], "AGPL-3.0": ["GNU AGPL v3", "AGPL v3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"], "EPL-2.0": ["Eclipse Public License 2.0", "EPL 2.0", "EPL-2.0"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"],
}
SAID = ["Licensed under the {}", "Licensed under the {} License", "Released under the {}", "Released under the {} License", "Distributed under the {}", "Distributed under the {} License", "{} License", "{} Licenses"]
FORMS |= {
    "CC-BY-3.0": [CC.format("").replace("4.0", "3.0"), "Licensed under CC BY 3.0."],
    "CC-BY-SA-3.0": [CC.format("-ShareAlike").replace("4.0", "3.0"), "Licensed under CC BY-SA 3.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
}
SPDX |= {k: [k] for k in ("CC-BY-3.0", "CC-BY-SA-3.0", "Unlicense", "BSL-1.0")}
for _name, _ids in SPDX.items():
    FORMS.setdefault(_name, []).extend(f"SPDX-License-Identifier: {i}" for i in _ids)
for _name, _called in NAMES_OF.items():
    FORMS.setdefault(_name, []).extend(s.format(c) for c in _called for s in SAID if not (s.startswith("{}") and "License" in c))
    # a colon is no word, and "mit" is one in other texts
    FORMS[_name] += [f"License: {c}" for c in _called if c not in ("MIT", "ISC")]

SEGMENT = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|$)")
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


IDENTIFIER = "spdx-license-identifier"
IDS = frozenset(i.lower() for ids in SPDX.values() for i in ids)


def spelt_out(words: list[str]) -> list[str]:
    """Words with the identifier before every license of an SPDX expression, not before its first one alone."""
    out: list[str] = []
    in_expression = False
    for w in words:
        if in_expression and w not in IDS and w not in ("or", "and", "with"):
            in_expression = False
        if in_expression and w in IDS and out[-1] != IDENTIFIER:
            out.append(IDENTIFIER)
        in_expression = in_expression or w == IDENTIFIER
        out.append(w)
    return out


def cues_of(templates: list[list[str]]) -> frozenset[str]:
    """Words of which every text that keeps KEPT of a template's words has one: of each template as many of its longest words as
    can be lost, and one more."""
    return frozenset(w for t in templates for w in sorted(set(t), key=lambda w: (-len(w), w))[: int((1 - KEPT) * len(t) + 1e-9) + 1])


def blocks(text: str, cues: frozenset[str], known: list[frozenset[str]]):
    """(start, end) of each run of segments with a cue.

    Segments beside them belong to the run too if KEPT of their words are in one of `known`, the templates' words: the
    other lines of a wrapped or long notice.
    """
    parts = [(m.start(), m.end(), words_of(m[0])) for m in SEGMENT.finditer(text) if m[0].strip()]
    taken = [not cues.isdisjoint(words) for _, _, words in parts]
    fits: dict[int, bool] = {}

    def belongs(i: int) -> bool:
        if i not in fits:
            words = parts[i][2]
            fits[i] = any(sum(w in t for w in words) >= KEPT * len(words) for t in known)
        return fits[i]

    for order, step in ((range(1, len(parts)), -1), (range(len(parts) - 2, -1, -1), 1)):
        for i in order:
            taken[i] = taken[i] or (taken[i + step] and belongs(i))
    run: list[int] | None = None
    for (start, end, _), inside in zip(parts, taken):
        if inside:
            run = [run[0] if run else start, end]
        elif run:
            yield tuple(run)
            run = None
    if run:
        yield tuple(run)


def differences(template: list[str], block: list[str | None]) -> tuple[float, list[str], list[int]]:
    """Share of the template's words that the block has in order, the words lost (-) and added (+), and the places of
    the words kept. Places that are None were taken by another template. A template of SHORT words or fewer has to stand in one
    piece. Of the block, only the template's own words are compared, so a long block costs time in proportion to its length.
    """
    if len(template) <= SHORT:
        at = next((i for i in range(len(block) - len(template) + 1) if block[i : i + len(template)] == template), None)
        own, places = range(0 if at is None else len(template)), [] if at is None else list(range(at, at + len(template)))
    else:
        words = frozenset(template)
        where = [i for i, w in enumerate(block) if w in words]
        matches = SequenceMatcher(None, template, [block[i] for i in where], autojunk=False).get_matching_blocks()
        own = [a + k for a, _, n in matches for k in range(n)]
        places = [where[b + k] for _, b, n in matches for k in range(n)]
    lost, taken = set(range(len(template))).difference(own), set(places)
    said = [f"-{template[i]}" for i in sorted(lost)] + [f"+{w}" for i, w in enumerate(block) if w is not None and i not in taken]
    return len(places) / max(1, len(template)), said, places


# Names of whole license texts as some systems file them, and the licenses they are.
FILED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def whole_texts(folder: str) -> dict[str, list[str]]:
    """Whole license texts from a folder of the driver, for scan(forms=...): a file for each license, named as in FILED."""
    import os

    found: dict[str, list[str]] = {}
    for name, license in FILED.items():
        if os.path.isfile(f"{folder}/{name}"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                found.setdefault(license, []).append(f.read())
    return found


class Scanner:
    def __init__(self, templates: dict[str, str], forms: dict[str, list[str]] | None = None):
        import zstandard

        self.license = {k: k for k in templates}
        for name, more in (forms or {}).items():
            templates = templates | {f"{name}#{i}": x for i, x in enumerate(more)}
            self.license |= {f"{name}#{i}": name for i in range(len(more))}
        make = lambda **more: zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_checksum=0, write_dict_id=0), **more)
        self.plain = make()
        self.words = {k: words_of(v) for k, v in templates.items()}
        self.with_template = {k: make(dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, w in self.words.items()}
        self.cues, self.sets = cues_of(list(self.words.values())), list({frozenset(w) for w in self.words.values()})
        self.known: dict[tuple, list[tuple]] = {}

    def blocks(self, text: str):
        return blocks(text, self.cues, self.sets)

    def ranking(self, block: str) -> list[tuple[float, str]]:
        """(share by which the template makes the block smaller, template), greatest first."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, k) for k, c in self.with_template.items()), key=lambda x: (-x[0], x[1]))

    def confirm(self, key: str, words: list[str | None], there: collections.Counter) -> tuple[float, list[str], list[int]] | None:
        """kept, differences and places of a template, if KEPT of its words are there in order, all its numbers among them."""
        template = self.words[key]
        need = collections.Counter(template)
        if (need & there).total() < KEPT * len(template) or any(there[w] < n for w, n in need.items() if any(c.isdigit() for c in w)):
            return None
        kept, said, places = differences(template, words)
        numbers = {w for w in template if any(c.isdigit() for c in w)}
        return (kept, said, places) if kept >= KEPT and not numbers & {w[1:] for w in said if w[0] == "-"} else None

    def scan_all(self, block: str) -> list[tuple]:
        """(license, reduction, kept, differences) of each license that the block holds, no word in two.

        The block goes to the template that makes it smallest, if its wording is there; else to the next. Its words are taken
        out, the rest is compressed with all templates again, and so on until none that is left is confirmed."""
        words = spelt_out(words_of(block))
        if (key := tuple(words)) not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[key] = found = []
            left: list[str | None] = list(words)
            while rest := [w for w in left if w is not None]:
                there, done = collections.Counter(rest), {name for name, *_ in found}
                for gain, k in self.ranking(" ".join(rest)):
                    if self.license[k] not in done and (got := self.confirm(k, left, there)):
                        break
                else:
                    break
                kept, said, places = got
                found.append((self.license[k], gain, kept, said))
                for i in places:
                    left[i] = None
        return self.known[key]

    def scan(self, block: str) -> tuple | None:
        """The first of scan_all, or None."""
        return next(iter(self.scan_all(block)), None)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, forms: dict[str, list[str]] | None = None) -> DataFrame:
    """A row per license that a block holds: doc_id, start, length (characters), license, reduction, kept, differences, block.

    templates replace TEMPLATES and FORMS; forms are further wordings of licenses, such as whole_texts gives.
    """
    small_batches(docs.sparkSession)
    wanted = templates or TEMPLATES
    known_forms = {} if templates else FORMS
    more = {k: [*known_forms.get(k, []), *(forms or {}).get(k, [])] for k in dict.fromkeys([*known_forms, *(forms or {})])}
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        scanner = Scanner(wanted, more)
        any_cue = "|".join(map(re.escape, sorted(scanner.cues)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.string())
        names = ("doc_id", "start", "length", "license", "reduction", "kept", "differences", "block")
        for b in slices(batches):
            b = b.filter(pc.match_substring_regex(b.column("text"), any_cue, ignore_case=True))
            out = [(i, s, e - s, *found, t[s:e]) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for s, e in scanner.blocks(t) for found in scanner.scan_all(t[s:e])]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], list(names))

    return texts.mapInArrow(run, "doc_id long, start long, length long, license string, reduction double, kept double, differences array<string>, block string")
