"""License scans by a positional rare-token index.

Method: templates (licence texts, notices and names) are indexed by word with positions. A template of n
words is found in a file where a run of words, a fifth longer than it at most, holds `threshold` of its
words in order (longest common subsequence; so words may be lacking, altered or inserted) and all its
mandatory key phrases. At most m = n - threshold n of its words can lack there, so of its 2m + 1 words of
highest IDF (document frequencies are counted over all documents) m + 1 at least are in the run, and their
relative positions agree but for what was left out or inserted. The postings of these words are therefore
intersected by relative position, within 3m places, and only runs that enough of them agree on are
aligned. The index thus misses no match; frequencies decide its cost, never its result. A name
(a template that is its own key phrase) is no match where a word of denial stands shortly before it, as in
"not under the MIT license". The score is the
share of the template's words in the best run.

Base: fixed phrases, counted wherever their words stand consecutively. Null texts count as empty; empty
tables give empty results; repeated rows give repeated results; other columns are not read. Ids may be of
any type.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import col, pieces

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and labels of the base.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Names of licences; each is a template and its own key phrase.
NAMES = {
    "mit": ["mit license", "mit licence", "spdx license identifier mit"],
    "apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "spdx license identifier apache 2 0"],
    "bsd": ["bsd license", "bsd 2 clause", "bsd 3 clause", "bsd style license", "new bsd license"],
    "isc": ["isc license", "spdx license identifier isc"],
    "zlib": ["zlib license", "spdx license identifier zlib"],
    "bsl-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "mpl-2.0": ["mozilla public license 2 0", "mozilla public license v 2 0", "mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "epl-2.0": ["eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0", "spdx license identifier epl 2 0"],
    "gpl-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "spdx license identifier gpl 2 0"],
    "gpl-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "spdx license identifier gpl 3 0"],
    "agpl-3.0": ["gnu affero general public license", "spdx license identifier agpl 3 0"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "spdx license identifier lgpl"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution 4 0 international"],
    "cc-by-sa-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international"],
    "cc-by-nc-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "cc-by-nd-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"],
    "cc-by-nc-sa-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"],
    "cc-by-nc-nd-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"],
    "cc0": ["cc0 1 0", "creative commons zero", "spdx license identifier cc0 1 0"],
    "unlicense": ["the unlicense", "spdx license identifier unlicense"],
    "artistic-2.0": ["artistic license 2 0", "spdx license identifier artistic 2 0"],
}

#: Families that are named by initials and a version, and their versions; label and spelling follow the rule below.
VERSIONS = {"gpl": ["2.0", "3.0"], "lgpl": ["2.1", "3.0"], "agpl": ["3.0"]}
CC_KINDS, CC_VERSIONS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"], ["2.0", "2.5", "3.0", "4.0"]
#: Words that deny a name when one of them stands within DENIED words before it.
NOT, DENIED = frozenset((b"not", b"never", b"isn", b"aren", b"wasn", b"doesn", b"nor")), 4


def versioned() -> dict[str, list[str]]:
    """Names by initials and version: `gpl 3`, `gplv3`, `gpl v3`, `gpl version 3`, `cc by sa 3 0` and the like, by label."""
    out: dict[str, list[str]] = {}
    for family, versions in VERSIONS.items():
        for v in versions:
            major, whole = v.removesuffix(".0").replace(".", " "), v.replace(".", " ")
            label = "lgpl" if family == "lgpl" else f"{family}-{v}"
            out.setdefault(label, []).extend(f"{family}{x}" for x in (f" {major}", f"v{major}", f" v{major}", f" version {major}", f" {whole}") if f"{family}{x}" not in out[label])
    for kind in CC_KINDS:
        for v in CC_VERSIONS:
            out.setdefault(f"cc-{kind}-{v}", []).append(f"cc {kind.replace('-', ' ')} {v.replace('.', ' ')}")
    return out


NAMES["apache-2.0"] += ["apache 2 0", "apache license 2", "apache license version 2", "apache license v2"]
NAMES["cc0"] += ["cc0"]
for _label, _names in versioned().items():
    NAMES.setdefault(_label, [])
    NAMES[_label] += [x for x in _names if x not in NAMES[_label]]

#: Label, text and mandatory key phrases of licence texts and notices, public and in wide use.
TEXTS = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["permission is hereby granted", "free of charge"],
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ["permission to use copy modify", "is hereby granted"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        ["source and binary forms"],
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms", "following conditions"]),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["neither the name of", "endorse or promote products"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        ["alter it and redistribute it freely"],
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        ["person or organization obtaining a copy"],
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["apache license"],
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["mozilla public license"]),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ["gnu general public license", "version 2 of the license"],
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["gnu general public license", "version 3 of the license"],
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ["lesser general public license"],
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["released into the public domain"],
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["released into the public domain"]),
    (
        "apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        ["each contributor hereby grants to you", "derivative works of"],
    ),
    (
        "gpl-2.0",
        """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.""",
        ["your freedom to share and change", "applies to most of the free software foundation s software"],
    ),
    (
        "gpl-3.0",
        """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.""",
        ["gnu general public license is a free copyleft license"],
    ),
    (
        "agpl-3.0",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        ["affero general public license is a free copyleft license"],
    ),
    (
        "lgpl",
        "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
        ["specially designated software packages"],
    ),
    (
        "lgpl",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
        ["supplemented by the additional permissions"],
    ),
    (
        "mpl-2.0",
        """Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: (a) under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work""",
        ["licensable by such contributor", "larger work"],
    ),
    (
        "epl",
        """The accompanying program is provided under the terms of this Eclipse Public License ("Agreement"). Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.""",
        ["terms of this eclipse public license"],
    ),
    (
        "bsd",
        """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.""",
        ["copyright holders and contributors", "are disclaimed"],
    ),
    (
        "isc",
        """The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.""",
        ["the author disclaims all warranties"],
    ),
]


def legal_codes() -> list[tuple[str, str, list[str]]]:
    """The opening sentence of the legal code of each kind of Creative Commons licence, version 4.0, by the rule that names them."""
    words = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}
    out = []
    for kind in CC_KINDS:
        name = "-".join(words[x] for x in kind.split("-"))
        text = f'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License ("Public License").'
        out.append((f"cc-{kind}-4.0", text, [f"creative commons {name} 4 0 international public license".replace("-", " ").lower()]))
    return out


TEXTS += legal_codes()
TEMPLATES = [(label, name, [name]) for label, names in NAMES.items() for name in names] + TEXTS
THRESHOLD = 0.8


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def places(words: list[bytes], phrase: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
    return [i for i in at.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]


def bits_of(template: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for p, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << p
    return out


def common_length(bits: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of a template of `n` words and `words`; a template's row of the table is one integer."""
    full = row = (1 << n) - 1
    for w in words:
        if m := bits.get(w):
            row = ((row + (row & m)) | (row & ~m)) & full
    return n - row.bit_count()


def denied(words: list[bytes], start: int) -> bool:
    """Whether a word of denial stands within DENIED words before `start`, and not as `not only`."""
    before = words[max(0, start - DENIED) : start]
    return any(w in NOT and before[k + 1 : k + 2] != [b"only"] for k, w in enumerate(before))


class Index:
    """The templates' postings, restricted to each template's words of highest IDF."""

    def __init__(self, frequency: dict[bytes, int], documents: int, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (label, text, keys) in enumerate(templates):
            t = words_of(text.encode())
            n = len(t)
            least = math.ceil(threshold * n - 1e-9)
            m = n - least
            idf = [math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in t]
            picked = sorted(range(n), key=lambda p: (-idf[p], t[p], p))[: 2 * m + 1]
            for p in picked:
                self.postings[t[p]].append((i, p))
            phrases = [words_of(k.encode()) for k in keys]
            self.templates.append((label, n, least, m, bits_of(t), phrases, {w for k in phrases for w in k}, keys == [text]))

    def match(self, words: list[bytes], at: dict[bytes, list[int]], present: set[bytes]) -> dict[str, float]:
        """Label and best score of the templates found; `at`: places of the index's words."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for w in self.postings.keys() & at.keys():
            for i, p in self.postings[w]:
                if self.templates[i][6] <= present:
                    hits[i] += [(x - p, p) for x in at[w]]
        found: dict[str, float] = {}
        for i, begins in hits.items():
            label, n, least, m, bits, phrases, _, is_name = self.templates[i]
            begins.sort()
            window: Counter = Counter()
            left, done = 0, -1
            for right, (begin, p) in enumerate(begins):
                window[p] += 1
                while begins[left][0] < begin - 3 * m:
                    q = begins[left][1]
                    window[q] -= 1
                    if not window[q]:
                        del window[q]
                    left += 1
                if len(window) <= m or found.get(label, 0.0) >= 1:
                    continue
                # a run that begins at s has these words within s - m to s + 2 m; runs tried for the last word aren't tried again
                for s in range(max(0, begin - 2 * m, done + 1), min(len(words), begin + m + 1)):
                    done = s
                    run = words[s : s + n + m]
                    got = common_length(bits, n, run)
                    if got >= least and got / n > found.get(label, 0.0) and all(any(run[k : k + len(y)] == y for k in range(len(run))) for y in phrases) and not (is_name and denied(words, s)):
                        found[label] = got / n
        return found


def frequencies(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """Over all documents: in how many each word of the templates stands (as many numbers as the templates have words), and their number."""
    wanted = {w for _, t, _ in templates for w in words_of(t.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in pieces(batches, "text"):
            for t in b.column("text").to_pylist():
                seen.update(wanted.intersection(words_of(t)))
                seen[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(col(text).cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    score: the best of the method's matches, or 1 where only a base phrase is found, or 0.
    """
    index = Index(*frequencies(docs, text, templates), templates)  # some hundred words, whatever the corpus
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
    wanted = {p[0] for p, _ in phrases} | index.postings.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out: list[tuple] = []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                at: dict[bytes, list[int]] = {}
                if not wanted.isdisjoint(words):
                    for i, w in enumerate(words):
                        if w in wanted:
                            at.setdefault(w, []).append(i)
                hits = [(i, label) for p, label in phrases for i in places(words, p, at)] if at else []
                base = {label for _, label in hits}
                more = index.match(words, at, set(words)) if at else {}
                score = max(more.values(), default=1.0 if base else 0.0)
                starts = [i for i, _ in hits]
                out.append((len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more.keys())), score))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    source = docs.select(col(doc_id).alias("doc_id"), col(text).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
