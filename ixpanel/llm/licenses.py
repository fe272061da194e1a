"""License scan by conditional compression.

Candidate blocks of a text are the surroundings of words that license wording can't do without (CUES),
as many words to either side as the longest template has, cut into overlapping blocks of 48 words (in
longer ones a wording would be compressed by its likes elsewhere). Each is compressed alone, and once with each license as zstandard's raw dictionary (all its
wordings: the text and the usual notices). The licenses that make it smaller are ranked by how much;
no others are looked for. The wordings of the ranked ones are confirmed by exact word differences: a
wording must occur in order, but for a few words (copyright holders and years are not part of the
templates), and every word that names a license or a version must be there. The search goes on after
each confirmed occurrence, so each has its own span. Where occurrences overlap, the license that makes
the text they cover smallest is taken first, and what overlaps it goes.

Defined results: null and empty texts hold no license; a text may hold several, in the order of
their spans; repeated rows each keep their row; an empty table gives an empty result. Spans are in
code points, the end exclusive, with the punctuation that follows the last word.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import field_of, prepare, table

# The licenses' own public wordings, or the usual notices for them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-2.0": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. Neither the name of the nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "BSD-4-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. All advertising materials mentioning features or use of this
software must display the following acknowledgement: This product includes software developed by the. Neither the name of the nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
}
# Names in short notices, which are made by rule.
NAMES = {
    "MIT": ["MIT License", "MIT"], "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0"],
    "GPL-3.0": ["GNU General Public License v3.0", "GPLv3"], "LGPL-2.1": ["GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0"], "AGPL-3.0": ["GNU Affero General Public License v3.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0"],
}
TEMPLATES["Unlicense"] = "This is free and unencumbered software released into the public domain."
NAMES |= {f"CC-{p}-{v}": [f"CC {p} {v}"] for p in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")}
FORMS = ("Licensed under the {}", "Licensed under the terms of the {}", "Released under the {}",
         "This project is licensed under the {}", "License: {}")


def _wordings() -> dict[str, list[str]]:
    """All wordings of each license, the longest first."""
    out: dict[str, list[str]] = {}
    for name, text in TEMPLATES.items():
        out.setdefault(name.removesuffix("-notice"), []).append(text)
    for name in [*out, *NAMES]:
        own = out.setdefault(name, [])
        own.append(f"SPDX-License-Identifier: {name}")
        for n in NAMES.get(name, ()):
            made = [f.replace("the {}", "{}").format(n) if name.startswith("CC-") else f.format(n) for f in FORMS]
            own += [t for t in made if "licen" in t.lower()]         # else there would be no cue
    return {name: sorted(set(own), key=lambda t: (-len(t), t)) for name, own in out.items()}


WORDINGS = _wordings()
# Each template has more of these words than may be missing, so a text without one holds none of them.
CUES = ("licens", "licenc", "copyright", "permission", "permitted", "redistribut", "warrant", "merchantab", "domain",
        "spdx", "mozilla", "gnu", "apache")
MISSING = 0.05       # share of a template's words that may be missing
ADDED = 0.15         # words that may be added, as a share of the template's
KEY = re.compile(r"^(mit|apache|gnu|gpl|lgpl|agpl|affero|lesser|mozilla|cc|cc0|isc)$")     # names of licenses
VERSION = re.compile(r"^(v?[0-9][0-9.]*|version)$")     # list numbers, where the template has no version
PARTS = re.compile(r"^(by|sa|nc|nd)$")                  # of the names of Creative Commons licenses
# Words shortly after a license that make it another one: more clauses.
MORE = {"BSD-2-Clause": ("neither the name", "all advertising materials"), "BSD-3-Clause": ("all advertising materials",)}
BLOCK = 48           # words of a block that is compressed; the next one begins after half of them
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_CLOSE = re.compile(r"[^\w\s]*")


@lru_cache(maxsize=1000)
def keys_of(wording: tuple[str, ...]):
    """Tells the words that may be neither missing in a wording nor added to it."""
    kinds = [KEY] + [k for k, has in ((VERSION, VERSION.match), (PARTS, "cc".__eq__)) if any(map(has, wording))]
    return lambda w: any(k.match(w) for k in kinds)


def has_cue(low: str) -> bool:
    """Whether lower-case text or a word holds a cue."""
    return any(c in low for c in CUES)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _compressors():
    """A compressor alone, one for each license, and the words of its wordings."""
    def dictionary(texts):
        made = zstandard.ZstdCompressionDict(" ".join(" ".join(texts).split()).lower().encode(),
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=9)
        return made

    # The longest wording stands last: what is nearest to the text costs least to refer to.
    made = {k: zstandard.ZstdCompressor(level=9, dict_data=dictionary(reversed(t))) for k, t in WORDINGS.items()}
    return zstandard.ZstdCompressor(level=9), made, {k: [tuple(words_of(x)) for x in t] for k, t in WORDINGS.items()}


def ranked(block: str) -> list[tuple[float, str]]:
    """(share saved, license), best first, of all that make the block smaller; of equal ones the one with
    the shortest wordings first."""
    plain, given, _ = _compressors()
    raw = " ".join(block.split()).lower().encode()
    alone = len(plain.compress(raw))
    saved = [((alone - len(c.compress(raw))) / alone, k) for k, c in given.items()]
    return sorted(((s, k) for s, k in saved if s > 0), key=lambda x: (-x[0], sum(map(len, WORDINGS[x[1]])), x[1]))


def _limits(n: int) -> tuple[int, int]:
    """How many words of a template of n may be missing, and how many added."""
    return int(MISSING * n), int(ADDED * n)


@lru_cache(maxsize=1)
def _longest() -> int:
    """Words of the longest wording, with those that may be added."""
    return max(len(w) + _limits(len(w))[1] for own in _compressors()[2].values() for w in own)


@lru_cache(maxsize=1)
def _runs() -> dict[str, dict[int, dict[tuple[str, ...], list[tuple[int, int]]]]]:
    """For each license, by length: the runs of words its wordings can't do without, with the wording's
    number and the run's place. With at most m words missing and a added, a wording of n words keeps a run of
    (n - m) / (m + a + 1) words."""
    out: dict = {}
    for name, own in _compressors()[2].items():
        for k, want in enumerate(own):
            m, a = _limits(len(want))
            length = math.ceil((len(want) - m) / (m + a + 1))
            places = out.setdefault(name, {}).setdefault(length, {})
            for i in range(len(want) - length + 1):
                places.setdefault(want[i:i + length], []).append((k, i))
    return out


@lru_cache(maxsize=20_000)
def aligned(want: tuple[str, ...], have: tuple[str, ...]) -> tuple[int, int, tuple[str, ...], tuple[str, ...]] | None:
    """The occurrence of the wording ``want`` in ``have`` with the fewest differences: first and last word (exclusive),
    words missing and words added; None if that isn't one."""
    n, (most_missing, most_added) = len(want), _limits(len(want))
    there, key = set(have), keys_of(want)
    if sum(w not in there for w in want) > most_missing or any(w not in there for w in want if key(w)):
        return None
    far = most_missing + most_added + 1
    cost = [far if key(w) else 1 for w in have]
    # best[j]: differences of the first i words, the last word taken being have[j - 1] or, in ``best``, an added one
    rows = [[0] * (len(have) + 1)]
    for w in want:
        last, gone = rows[-1], far if key(w) else 1
        row = [last[0] + gone]
        for j, x in enumerate(have):
            d = min(last[j + 1] + gone, row[j] + cost[j])
            row.append(last[j] if x == w and last[j] <= d else d)
        rows.append(row)
    end = min(range(len(have) + 1), key=lambda j: (rows[n][j], j))
    if rows[n][end] >= far:
        return None
    i, j, missing, added, first = n, end, [], [], end
    while i:
        if j and want[i - 1] == have[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
            first = j
        elif j and rows[i][j] == rows[i][j - 1] + cost[j - 1]:
            j -= 1
            added.append(have[j])
        else:
            i -= 1
            missing.append(want[i])
    if len(missing) > most_missing or len(added) > most_added:
        return None
    return first, end, tuple(reversed(missing)), tuple(reversed(added))


def occurrences(words: list[str], names) -> list[tuple[int, int, str, tuple[str, ...], tuple[str, ...]]]:
    """Confirmed occurrences of each wording of the licenses ``names``, not of one overlapping: first and
    last word (exclusive), license, words missing and added."""
    wanted = _compressors()[2]
    out = []
    for name in names:
        seeds: dict[int, list[tuple[int, int]]] = {}
        for length, places in _runs()[name].items():
            for at, run in enumerate(zip(*(words[k:] for k in range(length)))):
                for k, i in places.get(run, ()):
                    seeds.setdefault(k, []).append((at, i))
        for k, found in seeds.items():
            want, free, tried = wanted[name][k], 0, set()
            n, added = len(want), _limits(len(want))[1]
            for at, i in found:
                if at < free or at - i in tried:
                    continue
                tried.add(at - i)
                if at - i >= free and tuple(words[at - i:at - i + n]) == want:
                    hit = (at - i, at - i + n, (), ())
                else:
                    begin = max(at - i - added, free)
                    if (hit := aligned(want, tuple(words[begin:at - i + n + added]))) is None:
                        continue
                    hit = (begin + hit[0], begin + hit[1], *hit[2:])
                free = hit[1]
                # More clauses follow within the words of the longest of these licenses.
                after = " ".join(words[free:free + _longest() - n]) if k == 0 else ""
                if not any(x in after for x in MORE.get(name, ())):
                    out.append((*hit[:2], name, *hit[2:]))
    return sorted(out)


def blocks(words: list[str]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Surroundings of cue words (first and last word, exclusive), and the blocks they are cut into: a
    wording of up to half a block lies in one whole, a longer one fills at least half of one."""
    wide, out = _longest(), []
    for k, w in enumerate(words):
        if has_cue(w):
            if out and k - wide <= out[-1][1]:
                out[-1][1] = k + wide + 1
            else:
                out.append([max(0, k - wide), k + wide + 1])
    step = BLOCK // 2
    return [(a, end, [(c, min(c + BLOCK, end)) for c in range(a, max(a + 1, end - step), step)])
            for a, b in out for end in (min(b, len(words)),)]


@lru_cache(maxsize=20_000)
def _saved(name: str, raw: bytes) -> float:
    plain, given, _ = _compressors()
    alone = len(plain.compress(raw))
    return (alone - len(given[name].compress(raw))) / alone


def saved(name: str, block: str) -> float:
    """The share by which a template makes a block smaller."""
    return _saved(name, " ".join(block.split()).lower().encode())


def licenses(text: str) -> list[tuple[int, int, str, float, str, str]]:
    """Licenses of a text: start, end, template, share saved, missing and added words."""
    low = text.lower()
    if not has_cue(low):
        return []
    if len(low) != len(text) or not text.isascii():
        low = "".join(c.lower() if c.isascii() else c for c in text)   # as long as the text
    at = [m.span() for m in _WORD.finditer(low)]
    words, found = [low[a:b] for a, b in at], []
    for begin, end, parts in blocks(words):
        names = {name for c, d in parts for _, name in ranked(text[at[c][0]:at[d - 1][1]])}
        found += [(begin + x, begin + y, *more) for x, y, *more in occurrences(words[begin:end], sorted(names))]
    found = sorted(set(found))
    out: list[tuple[int, int, str, float, str, str]] = []
    while found:
        end, size = found[0][1], 1          # those that overlap, directly or through others
        while size < len(found) and found[size][0] < end:
            end, size = max(end, found[size][1]), size + 1
        group, found = found[:size], found[size:]
        if size > 1:
            block = text[at[group[0][0]][0]:at[end - 1][1]]
            # The license that saves most; of its wordings the one with the fewest differences, then the longest.
            group.sort(key=lambda x: (-saved(x[2], block), len(x[3]) + len(x[4]), x[0] - x[1], x))
        kept: list[tuple] = []
        for x in group:
            if all(x[0] >= y[1] or x[1] <= y[0] for y in kept):
                kept.append(x)
        for first, last, name, missing, added in sorted(kept):
            a, b = at[first][0], at[last - 1][1]
            b = _CLOSE.match(text, b).end()
            out.append((a, b, name, round(saved(name, text[a:b]), 4), " ".join(missing), " ".join(added)))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and found (start, end, license, saved,
    missing, added) for each occurrence of a license."""
    def run(batches):
        for b in batches:
            rows = [[{"start": s, "end": e, "license": n, "saved": v, "missing": m, "added": a}
                     for s, e, n, v, m, a in licenses(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.struct(
                [("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()),
                 ("missing", pa.string()), ("added", pa.string())])))], ["doc_id", "found"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"{field_of(docs, 'doc_id')}, found array<struct<start: long, "
        "end: long, license: string, saved: double, missing: string, added: string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("found").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.expr("array_join(transform(found, f -> concat(f.license, ':', f.start, ':', f.end)), ',')").alias("spans"),
        F.expr("array_max(found.saved)").alias("most_saved"))
