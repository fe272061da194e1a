"""Decontamination, SimHash, secrets, personal data and licenses against plain Python."""

import hashlib
import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ixpanel.llm import decontaminate, licenses, pii, secret_scan, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, row string, hits string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use, too."""
    return spark.createDataFrame([(i, t, None, "s", None, 1, "k", "r", "h") for i, t in rows], DOCS)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---------------------------------------------------------------- decontamination

def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_hits(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        m = min(10, len(iw))
        if item is None or not m:
            continue
        for p in range(len(iw) - m + 1):
            for q in range(len(w) - m + 1):
                if w[q:q + m] == iw[p:p + m]:
                    hit |= set(range(q, q + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_windows", [1000, 3])
def test_windows_like_brute_force(spark, max_windows):
    rng = random.Random(3)
    vocab = ["the", "of", "É", "é", "x9", "a", "b"]
    long = " ".join(rng.choice(vocab) for _ in range(16))
    items = [(1, long), (2, "Only, four words here!"), (3, "the"), (4, None), (5, "..."), (6, long), (10, "É of É"),
             (None, "zz zz")]
    texts = [None, "", "?!", "The end", "only FOUR\nwords here", long.upper().replace("É", "É"), "x " + long + " y",
             " ".join(rng.choice(vocab) for _ in range(400)), "É of É of É", "é of é", "zz zz", "w " * 5000 + long]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "The end"), (None, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(docs(spark, rows), bench, max_windows=max_windows).collect()
    assert len(got) == len(rows)
    found = sorted((str(r.doc_id), r.n_words, sum(h.end - h.begin for h in r.hits), list(r["items"])) for r in got)
    assert found == sorted((str(i), *brute_hits(t, items)) for i, t in rows)


def test_no_benchmark_and_no_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.hits for r in decontaminate.find(docs(spark, [(1, "a b")]), bench).collect()] == [[]]
    assert decontaminate.find(docs(spark, []), bench).count() == 0


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    comp = list(ids)
    key = lambda i: (i is None, i or 0)
    while True:
        new = [min((comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3), key=key)
               for i in range(len(fps))]
        if new == comp:
            return comp
        comp = new


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", " x"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 80, 200]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t + " tail") for i, t in enumerate(base)] + [(200, None), (201, ""), (202, " \t "), (5, base[5])]
    rows += [(300, " ".join(["Long"] * 30000)), (301, "\n".join(["long"] * 30000)), (None, base[7])]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs(spark, rows), tile=4).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    assert got == {(i, f"{f:016x}"): c for (i, _), f, c in zip(rows, fps, want)}


def test_simhash_chain_and_empty(spark):
    """Tiles of crowded cells split; links over tiles still join chains."""
    fps = np.cumsum([0] + [1 << k for k in range(40)]).tolist()
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    from ixpanel.llm.components import connected_components
    roots = connected_components(simhash.links(table, radius=1, tile=1)).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 40
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secret_base_like_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "é😀 Token = \"" + "a" * 40 + "\"", "secret: token: abcdefgh", "AKIA" + "A1" * 9, "AKIAAKIA" + "B" * 11,
             "password==abcde", "api_key='x'", "PASSWD:" + "z" * 6 + "\napikey = 123456", "f" * 24 + " " + "g" * 24,
             "password=abcdef " * 1500, "0123456789abcdef" * 4000, "x" * 200000]
    texts += ["".join(rng.choice(["token", "=", " ", "\"", "AKIA", "A9", "abcdef", "0", ":", "é"]) for _ in range(300))
              for _ in range(30)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[3])]
    got = secret_scan.find(docs(spark, rows)).withColumn(
        "base", secret_scan.labelled([(k, k) for k in ("assign", "access", "hex")])).select(
        "doc_id", secret_scan.written("base").alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == sorted((str(i), brute_secrets(t)) for i, t in rows)


def test_random_tokens_are_found_and_words_left(spark):
    rng = random.Random(2)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = ["".join(rng.choice(b64) for _ in range(44)) for _ in range(60)]
    dull = ["abababababababababababababababababababababA1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaB2/"]
    rows = [(i, f"é {t} internationalizationally {dull[i % 2]}") for i, t in enumerate(tokens)]
    found = secret_scan.find(docs(spark, rows)).select("doc_id", F.explode("random").alias("r")).select("doc_id", "r.*").collect()
    assert all((r.start, r.end) == (2, 46) for r in found)       # nothing but the random ones
    assert len({r.doc_id for r in found}) >= 57                 # of 60; the level ALPHA costs a few in a thousand
    assert secret_scan.find(docs(spark, [])).count() == 0


def test_too_few_tokens_show_no_rate(spark):
    assert secret_scan.find(docs(spark, [(1, "Zk3Jd8sLq0PwX7vB2nM5cR9tY1uE")])).first()["random"] == []


# ---------------------------------------------------------------- personal data

def luhn(z):
    return sum(v // 10 + v % 10 for i, c in enumerate(reversed(z)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def brute_pii(t):
    t = t or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, "email", m.end())
           for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(digits(m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_base_like_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", "é a@b@c.de_x@d.ef.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111 1111 1111",
             "4111-1111 1111-1111 1@x.org", "+1 (743) 555-3824 +12345 ++49 30 1234567", "a@b.co " * 2000,
             "9" * 30000 + "@" + "a" * 30000, "." * 30000, "+" + "1 " * 9000]
    texts += ["".join(rng.choice(["1", "23", ".", "@", "a", "-", " ", "+", "4111111111111111", "x.y", "é", "("])
                      for _ in range(200)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (2, "other text b@c.de"), (None, texts[2])]
    got = pii.find(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert (sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.base]) for r in got)
            == sorted((str(i), brute_pii(t)) for i, t in rows))
    assert got[0].asDict().keys() >= {"lang", "fp", "key", "row", "hits"}


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"é the host: 10.0.0.{i} the {i}") for i in range(20)] + [(50, "é the host: 999.0.0.1 up"), (51, "the 999.0.0.2")]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows)).withColumn("r", pii.redacted()).collect()}
    assert [(s.kind, s.start, s.end) for s in got[50].every] == [("ctx_ip", 12, 21)]
    assert got[50].r == "é the host: <IP> up" and got[51].every == [] and got[51].r == "the 999.0.0.2"
    assert got[3].r == "é the host: <IP> the 3"


def brute_contexts(texts, rounds=3, confidence=0.5, min_seeds=3):
    """Discovered spans of each text, by plain counting."""
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+){3}",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    seen, total = [], collections.Counter()
    for k, text in enumerate(texts):
        for w in re.split(r"(?<=[:=])|\s+", text.lower()):
            total[w] += 1
        end = 0
        for i, m in enumerate(re.finditer(pii.TOKEN, text)):
            before = (" " if i == 0 else "") + text[end:m.start()][-(pii.LONGEST_WORD + 2):]
            end = m.end()
            word = re.search(r"[\s:=]([^\s:=]*[:=]|[^\s:=]+)\s?$", before)
            kind = next((b for b, p in base.items() if re.fullmatch(p, m[0]) and brute_pii(m[0]) == [(b, 0, len(m[0]))]), None)
            if word and 1 <= len(word[1]) <= pii.LONGEST_WORD:
                seen.append((k, m.start(), m.end(), word[1].lower(), m[0].lower(), kind))
    edges = collections.Counter((w, i, kind) for *_, w, i, kind in seen)
    uses = collections.Counter()
    for (w, i, kind), n in edges.items():
        uses[i] += n
    scores, good = {}, {}
    for _ in range(rounds):
        good = {}
        for word in {w for w, _, _ in edges}:
            mine = [(i, kind, n) for (w, i, kind), n in edges.items() if w == word]
            if sum(bool(kind) or i in scores for i, kind, _ in mine) < min_seeds:
                continue
            conf = {k: min(1.0, sum(n * (1.0 if kind == k else scores.get(i, {}).get(k, 0.0) if not kind else 0.0)
                                    for i, kind, n in mine) / total[word]) for k in pii.KINDS}
            if max(conf.values()) >= confidence:
                good[word] = conf
        scores = {}
        for i in {i for _, i, kind in edges if not kind}:
            of = {k: sum(n * good[w][k] for (w, j, _), n in edges.items() if j == i and w in good) / uses[i] for k in pii.KINDS}
            if max(of.values()) >= confidence:
                scores[i] = of
    out = [set() for _ in texts]
    for k, a, b, w, i, kind in seen:
        if not kind and w in good and b - a >= pii.LEAST:
            out[k].add((f"ctx_{max(pii.KINDS, key=lambda c: good[w][c])}", a, b))
    return out


def test_bootstrapped_contexts_like_plain_counting(spark):
    rng = random.Random(8)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"my phone: +1 {number()} ok" for _ in range(400)] + [f"contact: user{k}@mail.org" for k in range(60)]
    texts += [f"ip:10.1.{k}.7" for k in range(60)]
    unseen = ["phone: 743-555-3824", "phone: (743) 555 9999", "contact: @handle77", "contact: bob@localhost", "ip:999.0.0.1"]
    # Known only as discoveries behind "phone:", these make "fon" a pattern, which finds another one.
    again = [number() for _ in range(12)]
    texts += unseen + [f"phone: {x}" for x in again * 3] + [f"fon {x}" for x in again] + ["fon 200-300-4000", "the 999-300-4000"]
    texts += ["the " + str(k) + " of the " + number() for k in range(50)] + ["phone: 7", "phone:", "", "a=b:c=1234"]
    texts += [" ".join(rng.choice(["phone:", "the", "x1", "+1 743 555 3824", "12", "@me12", "ip:1.2.3.4", "ip:1.2.3.444", "=", "a@b.co"])
                       for _ in range(12)) for _ in range(40)]
    want = brute_contexts(texts)
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.every if s.kind.startswith("ctx_")}
           for r in pii.find(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == want
    found = {texts[k][a:b]: kind for k, spans in enumerate(want) for kind, a, b in spans}
    assert [found.get(x) for x in ("743-555-3824", "(743) 555 9999", "@handle77", "bob@localhost", "999.0.0.1")] == \
        ["ctx_phone", "ctx_phone", "ctx_email", "ctx_email", "ctx_ip"]
    assert found["200-300-4000"] == "ctx_phone" and "999-300-4000" not in found
    first = brute_contexts(texts, rounds=1)
    assert not any(texts[k][a:b] == "200-300-4000" for k, spans in enumerate(first) for _, a, b in spans)


def test_redaction_joins_overlaps(spark):
    rows = [(1, "x 4111 1111 1111 1111@x.org y"), (2, None), (3, "plain")]
    got = {r.doc_id: r.r for r in pii.find(docs(spark, rows)).withColumn("r", pii.redacted()).collect()}
    assert got == {1: "x <CARD> y", 2: "", 3: "plain"}
    assert pii.find(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- licenses

def test_licenses_and_differences(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "é intro\nReleased under the MIT License.\nend"), (2, "Copyright (c) 2020 Someone\n" + mit.replace("\n", " ")),
            (3, "This work is licensed under the GNU General Public License, version 2."), (4, "a licensed driver"), (5, None),
            (6, ""), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (8, mit.replace("WITHOUT", "WITH")),
            (9, "x\n" * 20000 + "Licensed under CC BY 4.0."), (1, "é intro\nReleased under the MIT License.\nend")]
    got = [(r.doc_id, r.found) for r in licenses.scan(docs(spark, rows)).collect()]
    names = {i: [f.license for f in found] for i, found in got}
    assert names == {1: ["MIT"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: [], 7: ["CC-BY-NC-4.0", "MIT"], 8: ["MIT"], 9: ["CC-BY-4.0"]}
    of = dict(got)
    assert (of[1][0].start, of[1][0].end) == (8, 39)
    assert (of[8][0].missing, of[8][0].added) == ("without", "with") and of[2][0].missing == ""
    assert len(got) == len(rows) and licenses.scan(docs(spark, [])).count() == 0


def test_compression_ranks_the_right_template():
    for name, text in licenses.TEMPLATES.items():
        assert licenses.ranked(text)[0][1].removesuffix("-notice") == name.removesuffix("-notice")


def test_usual_notices_and_tags():
    for text, name in (("SPDX-License-Identifier: MIT", "MIT"), ("Licensed under the MIT License.", "MIT"), ("License: MIT", "MIT"),
                       ("Licensed under the terms of the MIT license", "MIT"), ("released under the Apache License 2.0", "Apache-2.0"),
                       ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
                       ("// SPDX-License-Identifier: CC-BY-NC-ND-4.0", "CC-BY-NC-ND-4.0"),
                       ("This is free and unencumbered software released into the public domain.", "Unlicense")):
        for t in (text, "word " * 3000 + text + " and more " * 3000):
            assert [x[2] for x in licenses.licenses(t)] == [name], text


def test_blocks_and_ranks_lose_nothing():
    """Every license over the whole text, without blocks and compression, finds the same."""
    rng = random.Random(6)
    every = [t for own in licenses.WORDINGS.values() for t in own]
    filler = "the software of a license and permission to copy, provided as is under the terms public version 2.0 words".split()
    for _ in range(60):
        text = " ".join(rng.choice([rng.choice(every), " ".join(rng.choice(filler) for _ in range(rng.randint(1, 400))),
                                    " ".join(w for w in rng.choice(every).split() if rng.random() > 0.03)]) for _ in range(8))
        words = licenses.words_of(text)
        want = {x for x in licenses.occurrences(words, licenses.WORDINGS)}
        got = set()
        for begin, end, parts in licenses.blocks(words):
            assert parts[0][0] == begin and parts[-1][1] == end and all(a[1] - b[0] == licenses.BLOCK // 2 for a, b in zip(parts, parts[1:]))
            names = {n for c, d in parts for _, n in licenses.ranked(" ".join(words[c:d]))}
            got |= {(begin + x[0], begin + x[1], *x[2:]) for x in licenses.occurrences(words[begin:end], names)}
        assert {x[:3] for x in want} == {x[:3] for x in got}


def test_wrapped_license_texts():
    """Texts as their files wrap them, with blank lines, comment marks and runs of lines without license wording."""
    mit = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
    cc0 = "Dedicated to the public\n\n# domain under\n\n\n\nCC0 1.0."
    for name, text in (("MIT", mit), ("MPL-2.0", mpl), ("CC0-1.0", cc0)):
        for t in (text, "İ é\n" + text + "\ncode = 1\n"):
            (found,) = licenses.licenses(t)
            assert found[2] == name and t[found[0]:found[1]] in t
    a, b = licenses.licenses("İ " + mit)[0][:2]
    assert ("İ " + mit)[a:b] == mit[mit.index("Permission"):mit.index(" IN NO EVENT")]


def test_every_confirmed_license_has_a_cue():
    for text in (t for own in licenses.WORDINGS.values() for t in own):
        n = len(words := licenses.words_of(text))
        assert (sum(bool(licenses.has_cue(w)) for w in words) > int(licenses.MISSING * n)
                or any(licenses.KEY.match(w) and licenses.has_cue(w) for w in words))


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{}Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.

{}Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
BSD_3 = BSD + """
{}Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software
without specific prior written permission.
"""
GNU = """This {0} is free software: you can redistribute it and/or modify
it under the terms of the GNU {1} as published by
the Free Software Foundation, either version {2} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_license_families_keep_their_names():
    named = lambda t: [x[2] for x in licenses.licenses(t)]
    for marks in (("1. ", "2. ", "3. "), ("", "", ""), ("a) ", "b) ", "c) ")):
        assert named(BSD.format(*marks)) == ["BSD-2-Clause"]
        assert named(BSD_3.format(*marks)) == ["BSD-3-Clause"] == named(" ".join(BSD_3.format(*marks).split()))
    assert named(BSD_3.format("", "", "").replace("copyright holder", "one two three " * 8)) == []
    public = "General Public License"
    for kind, name, version, want in [
            ("program", public, "3", "GPL-3.0"), ("program", public, "2", "GPL-2.0"),
            ("program", "Affero " + public, "3", "AGPL-3.0"), ("program", "Lesser " + public, "3", "LGPL-3.0"),
            ("library", "Lesser " + public, "3", "LGPL-3.0"), ("library", "Lesser " + public, "2.1", "LGPL-2.1"),
            ("library", "Library " + public, "2", "LGPL-2.0"), ("library", public, "3", "GPL-3.0")]:
        assert named(GNU.format(kind, name, version)) == [want], want
    assert named("This work is licensed under the GNU Affero General Public License, version 3") == ["AGPL-3.0"]


def test_each_occurrence_of_a_license_has_its_span():
    text = BSD.format("1. ", "2. ")
    found = licenses.licenses(text * 50)
    assert [x[:3] for x in found] == [(k * len(text), (k + 1) * len(text) - 1, "BSD-2-Clause") for k in range(50)]
    altered = text.replace("source and binary forms", "no form at all whatever it be " * 4)
    assert [x[0] for x in licenses.licenses(altered + text + altered)] == [len(altered)]
