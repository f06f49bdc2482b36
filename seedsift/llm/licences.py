"""Licence notices found by the Dice coefficient over word bigrams.

A text is compared as a whole, by paragraph, by line and in every window of its words. Each such unit
is reduced to lower-case words; its bigrams and a template's, both with repeats, have the coefficient
2 * common / (both sizes). The sizes alone bound it from above: only templates whose size lies between
``t / (2 - t)`` and ``(2 - t) / t`` times the unit's can reach the threshold ``t``, so most units
are dismissed by their number of words and never make bigrams.

A window that begins or ends with a bigram the template lacks gains by losing it, so the best windows
begin and end at bigrams of the template. Only these places are looked at, and only where as many of
them as the threshold asks for lie within the longest window.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import byte_chunks, map_batches, text_bytes
from seedsift.llm.licence_texts import FULL_TEXTS

THRESHOLD = 0.8

# Customary notices and short licence texts, whatever the data.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
}

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "is free software: you can redistribute it and/or modify it under the terms of the {name} as "
    "published by the Free Software Foundation, either version {version} of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the {name} for more details."
)
_GNU_NAMES = {
    "GPL": ("GNU General Public License", ("2", "3")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", ("3",)),
}
_CC_NAMES = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_NAMED = {
    "Apache-2.0": ("the Apache License 2.0", "Apache 2.0", "the Apache 2.0 License"),
    "Apache-unversioned": ("the Apache License",),
    "Artistic-2.0": ("the Artistic License 2.0",),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "BSD-unversioned": ("the BSD License",),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "the Creative Commons Zero v1.0 Universal License"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the terms of the Eclipse Public License v. 2.0"),
    "ISC": ("the ISC License",),
    "MIT": ("the MIT License", "the MIT license (MIT)", "the terms of the MIT license"),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, Version 2.0"),
    "Unlicense": ("the Unlicense", "The Unlicense License"),
    "zlib": ("the zlib License",),
}


def _wordings() -> dict[str, str]:
    """Customary ways to name a licence, the same for all licences."""
    found = {}
    for licence, names in _NAMED.items():
        for k, name in enumerate(names):
            found[f"{licence} wording {2 * k + 1}"] = f"Licensed under {name}."
            found[f"{licence} wording {2 * k + 2}"] = f"Released under {name}."
        if not licence.endswith("unversioned"):
            found[f"{licence} tag"] = f"SPDX-License-Identifier: {licence}"
    for short, (name, versions) in _GNU_NAMES.items():
        found[f"{short}-unversioned"] = f"Licensed under the {name}."
        for version in versions:
            licence = f"{short}-{version if '.' in version else version + '.0'}"
            found[f"{licence} program"] = "This program " + _GNU.format(name=name, version=version)
            found[f"{licence} library"] = "This library " + _GNU.format(name=name, version=version)
            found[f"{licence} wording 1"] = f"Licensed under the {name}, version {version}."
            found[f"{licence} wording 2"] = f"Licensed under the {name} v{licence.split('-')[1]}."
            found[f"{licence} wording 3"] = f"Licensed under the {short}v{version}."
            for end in ("", "-only", "-or-later"):
                found[f"{licence} tag{end}"] = f"SPDX-License-Identifier: {licence}{end}"
    for kind, name in _CC_NAMES.items():
        for version, where in _CC_VERSIONS.items():
            licence = f"CC-{kind}-{version}"
            found[f"{licence} wording 1"] = f"Licensed under CC {kind} {version}."
            found[f"{licence} wording 2"] = f"Licensed under CC-{kind} {version}."
            found[f"{licence} wording 3"] = (
                f"This work is licensed under a Creative Commons {name} {version} {where} License."
            )
            found[f"{licence} wording 4"] = f"Licensed under Creative Commons {name} {version}."
            found[f"{licence} tag"] = f"SPDX-License-Identifier: {licence}"
    return found


TEMPLATES |= {
    "BSD-2-Clause text": _BSD + _BSD_END,
    "BSD-3-Clause notice": _BSD + (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission."
    ),
    "BSL-1.0 notice": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file "
        "LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"
    ),
    "CC0-1.0 notice": (
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work."
    ),
    "EPL-2.0 notice": (
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Unlicense notice": (
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means."
    ),
    "zlib notice": (
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:"
    ),
} | _wordings()


def default_templates() -> dict[str, str]:
    """Notices and full texts."""
    return TEMPLATES | FULL_TEXTS


_WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")


def normalised(text: str) -> list[str]:
    """The words of a text: small letters and digits, inner points and hyphens kept."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    """Pairs of neighbouring words; a single word stands for itself."""
    return Counter(zip(words, words[1:]) if len(words) > 1 else [(w,) for w in words])


def dice(one: Counter, two: Counter) -> float:
    both = one.total() + two.total()
    return 2 * (one & two).total() / both if both else 0.0


class Templates:
    """Templates by size."""

    def __init__(self, texts: Mapping[str, str], threshold: float):
        found = sorted(
            (max(b.total(), 1), name, b)
            for name, text in texts.items()
            if (b := bigrams(normalised(text)))
        )
        self.sizes = [size for size, _, _ in found]
        self.rows = [(name, b) for _, name, b in found]
        self.threshold = threshold
        self.low = threshold / (2 - threshold)
        self.holders = defaultdict(list)
        for k, (_, own) in enumerate(self.rows):
            for gram in own:
                self.holders[gram].append(k)

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """The closest template that reaches the threshold, ties to the smaller name."""
        size = max(len(words) - 1, 1)
        # Rounding must not turn a template at the very bound away.
        i = bisect_left(self.sizes, size * self.low - 1e-9)
        j = bisect_right(self.sizes, size / self.low + 1e-9)
        if i == j or not words:
            return None
        # What both hold is at least ``low`` times the unit's size.
        pairs = zip(words, words[1:]) if len(words) > 1 else [(words[0],)]
        own = [g for g in pairs if g in self.holders]
        if len(own) < size * self.low - 1e-9:
            return None
        common = Counter()
        for gram, n in Counter(own).items():
            for t in self.holders[gram]:
                common[t] += min(n, self.rows[t][1][gram])
        score, name = max(
            (
                (2 * n / (size + self.sizes[t]), self.rows[t][0])
                for t, n in common.items()
                if i <= t < j
            ),
            key=lambda x: (x[0], _reverse(x[1])),
            default=(0.0, ""),
        )
        return (name, score) if score >= self.threshold else None

    def windows(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """(name, coefficient, first word, word after the last) of windows that reach the threshold,
        by falling coefficient, then name, then place; none overlaps one before it."""
        hits = defaultdict(list)
        get = self.holders.get
        for k, gram in enumerate(zip(words, words[1:])):
            for t in get(gram, ()):
                hits[t].append(k)
        found = []
        for t, places in hits.items():
            found += self._windows_of(t, places, words)
        for k, word in enumerate(words):
            found += [(self.rows[t][0], 1.0, k, k + 1) for t in get((word,), ())]
        taken, kept = [], []
        for name, score, i, j in sorted(found, key=lambda f: (-f[1], f[0], f[2], f[3])):
            at = bisect_right(taken, (i, j))
            if (at == 0 or taken[at - 1][1] <= i) and (at == len(taken) or taken[at][0] >= j):
                taken.insert(at, (i, j))
                kept.append((name, score, i, j))
        return kept

    def _windows_of(self, t: int, places: list[int], words: list[str]):
        """The best window of template ``t`` from each of ``places``, its bigrams' in the text."""
        size, (name, own) = self.sizes[t], self.rows[t]
        least, longest = int(np.ceil(size * self.low - 1e-9)), int(size / self.low + 1e-9)
        if len(places) < least:
            return
        at = np.array(places)
        close = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < longest)
        if not len(close):
            return
        # A bigram counts in a window unless the window holds it as often before as the template.
        seen, full = defaultdict(list), np.full(len(at), -1)
        for k, p in enumerate(places):
            gram = (words[p], words[p + 1])
            before = seen[gram]
            if len(before) >= own[gram]:
                full[k] = before[-own[gram]]
            before.append(p)
        stops = np.searchsorted(at, at[close] + longest)
        for i, j in zip(close.tolist(), stops.tolist()):
            first = places[i]
            score = 2 * np.cumsum(full[i:j] < first) / (at[i:j] - first + 1 + size)
            k = int(score.argmax())
            if score[k] >= self.threshold:
                yield name, float(score[k]), first, places[i + k] + 2


def _reverse(name: str) -> tuple[int, ...]:
    return tuple(-ord(c) for c in name) + (1,)


def scan(text: str, templates: Templates) -> list[tuple[str, float, str, int]]:
    """(template, coefficient, kind of unit, number of the unit) of every unit that matches, then of
    the windows that match best apart from each other, numbered by their first word, unless they
    are just the words of such a unit."""
    found, known = [], set()
    lines = text.split("\n")
    line_words = [normalised(line) for line in lines]
    all_words = [w for words in line_words for w in words]
    units = [("line", line_words)]
    if len(lines) > 1:
        parts = _PARAGRAPH.split(text)
        units += [("paragraph", map(normalised, parts))] if 1 < len(parts) < len(lines) else []
        units += [("text", [all_words])]
    for kind, parts in units:
        done = 0
        for k, words in enumerate(parts):
            if words and (best := templates.best(words)):
                found.append((*best, kind, k))
                known.add((best[0], done, done + len(words)))
            done += len(words)
    for name, score, i, j in templates.windows(all_words):
        if (name, i, j) not in known:
            found.append((name, score, "window", i))
    return found


def licence_scan(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, licence, dice, unit, unit_number, n_matches) for every row of ``docs``.

    The best match of each text: highest coefficient, then the smaller name, then lines before
    paragraphs before the whole text before windows, then the earlier unit; NULL where nothing reaches the
    threshold, as for NULL and empty texts, with 0 matches. Repeated rows give equal rows; other
    columns are not looked at. An empty table gives an empty result. One pass, no shuffle.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    known = dict(default_templates() if templates is None else templates)
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        table = Templates(known, threshold)
        order = {"line": 0, "paragraph": 1, "text": 2, "window": 3}
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for i, j in byte_chunks(texts):
                rows = []
                for text in texts[i:j].to_pylist():
                    found = scan(text.decode("utf-8", "replace"), table)
                    best = min(found, key=lambda f: (-f[1], f[0], order[f[2]], f[3]), default=())
                    rows.append((*(best or (None,) * 4), len(found)))
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(i, j - i),
                        *[pa.array(c, kind) for c, kind in zip(columns, kinds)],
                    ],
                    ["id", "licence", "dice", "unit", "unit_number", "n_matches"],
                )

    return map_batches(
        given,
        run,
        "id bigint, licence string, dice double, unit string, unit_number bigint, n_matches bigint",
    ).withColumnRenamed("id", id_col)
