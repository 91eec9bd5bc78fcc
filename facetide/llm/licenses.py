"""License scans by conditional compression.

A wording holds ``percent`` of its template's words, so it holds some of any few words that are more than the rest: each template's
longest such words are its marks (``Scanner.marks``), taken from the templates, and a text without any mark holds no license.
Candidate blocks are the marks of a text with as many words on both sides as the template has, whatever the line breaks; those that
overlap or touch are one block. A block is compressed alone and once with each
template as a raw zstandard dictionary; the share of its size that the template saves ranks the templates. Those that
save most, and nearly as much, or else the next that agree, are confirmed by exact wording: the words of template and block are aligned, and the
block must hold ``percent`` of the template's words in order, every word of the template that tells it from its
relatives (names, numbers, versions: words that not all templates of one cue have) included.

Templates are one-line notices (``TEMPLATES``) and the longer wordings of licenses (``TEXTS``): MIT's and BSD's whole terms, the
headers of Apache, GNU and Mozilla, Creative Commons' sentences, and the headings with the opening words of the long legal texts, by which
such a text is found. Templates are a bounded list: sent with the function. Texts are scanned where they lie, without shuffle; a text's equal
blocks are looked at once, and a worker remembers verdicts of blocks it met (``BLOCKS_REMEMBERED``).

Defined cases: null and empty texts hold no license; a text may hold several licenses, and one license at several places
(all are returned); templates without words match nothing; of templates that confirm equally well the longest wins, then
the one that saves most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts


BLOCKS_REMEMBERED = 200_000
LEVEL = 3
NEAR_BEST = 0.5  # templates that save less than this share of the best one's saving are compared only if none before agreed
SLACK = 3  # words that may stand between a template's

# Wording by which works name their license.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-Rights-Reserved": "All rights reserved.",
}

# Headers, terms, and openings of legal texts.
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
)

_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """Templates (license, wording) ready to compress and compare with."""

    def __init__(self, templates: list[tuple[str, str]], percent: int):
        self.percent = percent
        self.license = [name for name, _ in templates]
        self.words = [wording(text) for _, text in templates]
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.given = {
            k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for k, (_, text) in enumerate(templates)
            if self.words[k]
        }
        self.telling = {k: self._telling(k) for k in self.given}
        self.marks: dict[str, int] = {}
        for k in self.given:
            for w in self._marks(self.words[k]):
                self.marks[w] = max(self.marks.get(w, 0), len(self.words[k]) + SLACK)

    def _telling(self, k: int) -> list[str]:
        """Words that some closely related template of another license does not have."""
        own = set(self.words[k])
        related = [set(w) for n, w in enumerate(self.words) if self.license[n] != self.license[k] and w and len(own & set(w)) * 2 >= len(own)]
        return [w for w in self.words[k] if any(w not in r for r in related)]

    def _marks(self, own: list[str]) -> list[str]:
        """The longest words of a template that cannot all be missing where ``percent`` of its words are held."""
        may_miss = len(own) - -(-self.percent * len(own) // 100)
        out, places = [], 0
        for w in sorted(set(own), key=lambda w: (-len(w), w)):
            out.append(w)
            places += own.count(w)
            if places > may_miss:
                break
        return out

    def marked(self, text: str) -> bool:
        lower = text.lower()
        return any(w in lower for w in self.marks)

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """First character and end of the words around marks, as far as a template can reach from them."""
        if not self.marked(text):
            return []
        found = list(_WORD.finditer(text))
        reach = [(i, r) for i, m in enumerate(found) if (r := self.marks.get(m.group().lower()))]
        out: list[tuple[int, int]] = []
        for first, last in sorted((max(0, i - r), min(len(found) - 1, i + r)) for i, r in reach):
            if out and first <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((first, last))
        return [(found[first].start(), found[last].end()) for first, last in out]

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """Share of the block's compressed size that each template saves, most first."""
        data = block.lower().encode()
        size = len(self.alone.compress(data))
        saved = [((size - len(c.compress(data))) / size, k) for k, c in self.given.items()]
        return sorted(saved, key=lambda x: -x[0])

    def scan(self, block: str) -> list[tuple[str, float, float, int, int]]:
        """(license, saved, agreement, start, end) of what the block holds; places are of characters."""
        out, todo = [], [(0, len(block))]
        while todo:
            begin, end = todo.pop()
            part = block[begin:end]
            found = self._best(part)
            if found:
                name, saved, agreed, first, last = found
                out.append((name, saved, agreed, begin + first, begin + last))
                todo.extend(x for x in ((begin, begin + first), (begin + last, end)) if self.marked(block[x[0] : x[1]]))
        return sorted(out, key=lambda x: x[3])

    def _best(self, part: str) -> tuple[str, float, float, int, int] | None:
        marks = list(_WORD.finditer(part.lower()))
        if not marks:
            return None
        words = [m.group() for m in marks]
        ranks = self.ranked(part)
        best = None
        for saved, k in ranks:
            if best and saved < NEAR_BEST * ranks[0][0]:
                break
            own = self.words[k]
            # where the wording begins is where most of its words line up with the block's
            for at in _starts(words, own):
                window = words[at : at + len(own) + SLACK]
                there = set(window)
                if 100 * sum(w in there for w in own) < self.percent * len(own):
                    continue
                match = [b for b in SequenceMatcher(None, own, window, autojunk=False).get_matching_blocks() if b.size]
                common = sum(b.size for b in match)
                agreed = common / len(own)
                held = {w for b in match for w in own[b.a : b.a + b.size]}
                if agreed * 100 >= self.percent and all(w in held for w in self.telling[k]):
                    last = at + match[-1].b + match[-1].size - 1
                    extra = last + 1 - at - common
                    if best is None or (agreed, -extra, len(own)) > best[0]:
                        best = ((agreed, -extra, len(own)), self.license[k], saved, agreed, marks[at + match[0].b].start(), marks[last].end())
        return best[1:] if best else None


def _starts(words: list[str], own: list[str]) -> list[int]:
    """Places of the block where the template's first words may stand."""
    heads = {w: i for i, w in reversed(list(enumerate(own[: max(1, len(own) // 2)])))}
    return sorted({max(0, k - heads[w]) for k, w in enumerate(words) if w in heads})


def found_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, percent: int = 90, texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """``id``, ``license``, ``start``, ``end`` (characters), ``wording``, ``saved``, ``agreement`` of every license found."""
    wordings = [*templates.items(), *texts]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wordings, percent)
        known: dict[str, list] = {}
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for begin, end in scanner.blocks(text or ""):
                    block = text[begin:end]
                    if block not in known:
                        if len(known) >= BLOCKS_REMEMBERED:
                            known.clear()
                        known[block] = scanner.scan(block)
                    rows.extend((name, lic, begin + s, begin + e, block[s:e], saved, agreed) for lic, saved, agreed, s, e in known[block])
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            names = ["id", "license", "start", "end", "wording", "saved", "agreement"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)

    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = bare.schema["id"].dataType.simpleString()
    return map_texts(bare, of, f"id {kind}, license string, start long, end long, wording string, saved double, agreement double")
