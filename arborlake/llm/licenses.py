"""Licence scans by sentence rules.

Each known licence sentence has an identifier. A text is cut into sentences, each is normalised to its words and looked
up, and the identifiers in order are matched against rules: a rule is a licence and the identifiers that make it up.
Longer rules come first and a sentence counts for one rule. A few pieces in between that are not known, as the numbers
of a list or a line of copyright, do not break a rule; a known sentence does.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm.common import map_slices, read

#: Unknown pieces that may stand between the end of one of a rule's sentences and the next.
GAP = 6

# Sentences of public licence notices.
SENTENCES = {
    "mit-short": "Released under the MIT License",
    "mit-short-2": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-no-event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-short-2": "Licensed under the GNU General Public License, version 3",
    "gpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "reserved": "All rights reserved",
}
#: (licence, identifiers in order)
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-no-event"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-no-event"]),
    ("MIT", ["mit-title-2", "mit-grant", "mit-notice", "mit-as-is", "mit-no-event"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-short-2"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-basis", "apache-limits"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-or-later", ["gpl3-header", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl3-header"]),
    ("GPL-2.0-or-later", ["gpl2-header", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-header"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-3.0-only", ["gpl3-short-2"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("LicenseRef-all-rights-reserved", ["reserved"]),
]

PIECES = re.compile(r"\n|[.!?;:](?=\s)")
WORDS = re.compile(r"[a-z0-9]+")


def normalise(sentence: str) -> tuple[str, ...]:
    """The words: runs of a-z and digits, lower-cased."""
    return tuple(WORDS.findall(sentence.lower()))


class Recogniser:
    def __init__(self, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None):
        self.known: dict[tuple[str, ...], str] = {normalise(s): i for i, s in (SENTENCES if sentences is None else sentences).items()}
        self.opening: dict[str, set[int]] = {}  # first word: lengths of the sentences that begin so
        for words in self.known:
            self.opening.setdefault(words[0], set()).add(len(words))
        self.rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1]))
        self.by_first: dict[str, list] = {}
        for rule in self.rules:
            self.by_first.setdefault(rule[1][0], []).append(rule)

    def sentences(self, text: str | None) -> tuple[int, list[tuple[tuple[int, int], str]]]:
        """The number of sentence pieces, and ((its first, its last piece), identifier) of each known sentence.

        A known sentence may run over any number of pieces, as lines end inside it; of two that begin alike the longer
        counts. Pieces without a word count nowhere.
        """
        pieces = [w for p in PIECES.split(text or "") if (w := normalise(p))]
        found, at, n = [], 0, 0
        opening = self.opening
        while at < len(pieces):
            n += 1
            first = pieces[at][0]
            if first in opening:
                lengths, words, ends = opening[first], [], {}
                most = max(lengths)
                for k in range(at, len(pieces)):  # a word each at least, so `most` pieces
                    words += pieces[k]
                    if len(words) > most:
                        break
                    ends[len(words)] = k
                hit = next((m for m in sorted(lengths & ends.keys(), reverse=True) if tuple(words[:m]) in self.known), None)
                if hit is not None:
                    found.append(((at, ends[hit]), self.known[tuple(words[:hit])]))
                    at = ends[hit] + 1
                    continue
            at += 1
        return n, found

    def licences(self, found: list[tuple[tuple[int, int], str]]) -> list[tuple[int, str]]:
        """(number of the first piece, licence) of each rule that matches, in order."""
        out, at = [], 0
        while at < len(found):
            for licence, ids in self.by_first.get(found[at][1], ()):
                own = found[at : at + len(ids)]
                if [i for _, i in own] == ids and all(b - a - 1 <= GAP for ((_, a), _), ((b, _), _) in zip(own, own[1:])):
                    out.append((found[at][0][0], licence))
                    at += len(ids)
                    break
            else:
                at += 1
        return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, sentence_ids, licences) for every row, over whole texts.

    n_sentences counts sentence pieces that have a word. Null and empty texts have none. licences: in the order of the
    text, each place once. Repeated rows and null ids give one row each.
    """

    def make():
        r = Recogniser()

        def f(ids, texts):
            got = [r.sentences(t) for t in texts]
            return [ids, [n for n, _ in got], [[i for _, i in s] for _, s in got], [[x for _, x in r.licences(s)] for _, s in got]]

        return f

    return map_slices(df, [id_col, text_col], make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_sentences bigint, sentence_ids array<string>, licences array<string>")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
