"""License statements by conditional compression.

A block of text is compressed alone and with each template as a raw dictionary; a template that the block repeats makes it
much smaller. The templates that save most are then compared with the block word by word. A notice is confirmed by its wording,
a short statement by the name and version of its license, in whatever words; the differences are reported.
"""

from __future__ import annotations

import bisect
import collections
import difflib
import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import map_texts

# Statements and notices of public licenses, as their stewards word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit": "Released under the MIT License.",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-notice": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met:""",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "isc-notice": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "zlib-notice": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "unlicense-notice": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means.""",
    "all-rights-reserved": "All rights reserved.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
TRIGGER = r"(?i)licen[sc]e|sublicen|copyright|permission is|redistribut|free software|public domain|unencumbered"
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
LEAST_SAVING, MOST_CHANGED = 0.15, 0.1

# Names of licenses as texts give them: by line breaks and comment signs between the words, a version in any of its forms.
S, G = r"[\s*#>\-]{1,80}", r"""[\s*#>,;:("'\-]{0,80}"""
LICENSE = r"licen[sc]ed?(?!\w)"
VERSION = rf"(?:{G}(?:version|ver\.?|v\.?)?\s{{0,4}}(?P<v>\d(?:\.\d+)*)(?!\w|\.\d))?"
PUBLISHED = rf"(?:{G}as{S}published{S}by{S}the{S}free{S}software{S}foundation)?(?:{G}either(?!\w))?"
GNU = rf"(?:gnu{S})?"
# family: (name, wording of a statement; {v} stands for ', version N')
FAMILIES = {
    "apache": (rf"apache(?:{S}software)?(?:{S}{LICENSE})?", "Licensed under the Apache License{v}."),
    "mit": (r"(?:mit|expat)(?!\w|\s+press)", "Released under the MIT License."),
    "lgpl": (rf"{GNU}(?:(?:lesser|library){S}general{S}public{S}{LICENSE}(?:{G}{GNU}lgpl\)?)?{PUBLISHED}|lgpl)", "This work is licensed under the GNU Lesser General Public License{v}."),
    "agpl": (rf"{GNU}(?:affero{S}general{S}public{S}{LICENSE}(?:{G}{GNU}agpl\)?)?{PUBLISHED}|agpl)", "This work is licensed under the GNU Affero General Public License{v}."),
    "gpl": (rf"{GNU}(?:general{S}public{S}{LICENSE}(?:{G}{GNU}gpl\)?)?{PUBLISHED}|gpl)", "This work is licensed under the GNU General Public License{v}."),
    "gfdl": (rf"{GNU}(?:free{S}documentation{S}{LICENSE}{PUBLISHED}|g?fdl)", "This work is licensed under the GNU Free Documentation License{v}."),
    "mpl": (rf"(?:mozilla{S}public{S}{LICENSE}|mpl)", "This Source Code Form is subject to the terms of the Mozilla Public License{v}."),
    "epl": (rf"(?:eclipse{S}public{S}{LICENSE}|epl)", "Licensed under the Eclipse Public License{v}."),
    "eupl": (rf"(?:european{S}union{S}public{S}{LICENSE}|eupl)", "Licensed under the European Union Public License{v}."),
    "cddl": (rf"(?:common{S}development{S}and{S}distribution{S}{LICENSE}|cddl)", "Licensed under the Common Development and Distribution License{v}."),
    "odbl": (rf"(?:open{S}database{S}{LICENSE}|odbl)", "Licensed under the Open Database License{v}."),
    "bsl": (rf"boost{S}software{S}{LICENSE}|bsl", "Licensed under the Boost Software License{v}."),
    "psf": (rf"(?:python{S}software{S}foundation{S}{LICENSE}|psf)", "Licensed under the Python Software Foundation License{v}."),
    "artistic": (rf"artistic(?:{S}{LICENSE})?", "Licensed under the Artistic License{v}."),
    "isc": (r"isc(?!\w)", "Licensed under the ISC License."),
    "zlib": (r"zlib(?!\w)", "Licensed under the zlib License."),
    "unlicense": (r"unlicense(?!\w)", "Released under the Unlicense."),
    "wtfpl": (r"wtfpl", "Licensed under the WTFPL."),
    "bsd": (rf"(?:(?P<n>[0-4]){S}clause{S})?(?:(?P<kind>new|modified|revised|simplified|original){S})?bsd(?:{S}(?P<m>[0-4]){S}clause)?(?!\w)", "Licensed under the {n}BSD License."),
    "cc0": (rf"(?:cc0|creative{S}commons{S}zero)", "Licensed under CC0{v}."),
    "cc-by": (rf"(?:creative{S}commons|cc){S}(?:by|attribution)(?P<parts>(?:{S}(?:nc|nd|sa|non(?:{S})?commercial|no(?:{S})?deriv(?:ative)?s|share(?:{S})?alike)(?!\w))*)(?!\w)", "Licensed under CC {parts}{v}."),
    "all-rights-reserved": (rf"all{S}rights{S}reserved(?!\w)", "All rights reserved."),
    "public-domain": (rf"(?:dedicated{S}to|released{S}(?:in)?to|placed{S}(?:in)?to|placed{S}in){S}the{S}public{S}domain(?!\w)", "Dedicated to the public domain."),
}
CC_KINDS = (("NC", "NonCommercial"), ("ND", "NoDerivatives"), ("SA", "ShareAlike"))
UNVERSIONED = frozenset("mit isc zlib unlicense wtfpl bsd all-rights-reserved public-domain".split())
# a text without any of these words does not name the family
KEYS = {"apache": ["apache"], "mit": ["mit", "expat"], "lgpl": ["lesser", "library", "lgpl"], "agpl": ["affero", "agpl"], "gpl": ["general", "gpl"], "gfdl": ["documentation", "fdl"],
        "mpl": ["mozilla", "mpl"], "epl": ["eclipse", "epl"], "eupl": ["european", "eupl"], "cddl": ["common", "cddl"], "odbl": ["database", "odbl"], "bsl": ["boost", "bsl"],
        "psf": ["python", "psf"], "artistic": ["artistic"], "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"], "wtfpl": ["wtfpl"], "bsd": ["bsd"], "cc0": ["cc0", "zero"],
        "cc-by": ["cc", "commons"], "all-rights-reserved": ["reserved"], "public-domain": ["domain"]}
NAMES = {family: re.compile(rf"(?<!\w){name}" + ("" if family in UNVERSIONED else VERSION) + rf"(?:{S}(?:international|unported|generic)(?!\w))?(?:{S}{LICENSE})?(?!\w)", re.I)
         for family, (name, _) in FAMILIES.items()}
SPDX = re.compile(r"spdx-license-identifier\s{0,8}:\s{0,8}\(?\s{0,8}([a-z0-9][a-z0-9.\-]*[a-z0-9])", re.I)
# what tells that an abbreviation means a license: a grant before it, or a field of that name
GRANT = re.compile(rf"""(?:\b(?:(?:re-?|dual-?)?licen[sc]ed|released|(?:re)?distributed|available|published|provided|covered|offered|shared|contributed|used)\b
    (?:[^.!?;\n]{{0,40}}?\bunder)|\blicen[sc]ed{S}(?:as|with|via)|\bunder{S}(?:the{S})?(?:terms|conditions)(?:{S}and{S}conditions)?{S}of|\blicen[sc]es?["']?\s{{0,4}}[:=]|-identifier\s{{0,8}}:
    |\blicen[sc]e{S}(?:is|are|type)|(?:^|\n)[^\w\n]{{0,8}}licen[sc]e[^\w\n]{{0,8}}\n)(?:{G}\b(?:the|a|an|is|either|both|terms|of|and|conditions|following|one))*[\s*#>,:("'\[=\-]*$""", re.I | re.X)
LISTED = re.compile(r"""[\s,/&|+*()\["'\-]*(?:(?:or|and|and/or|with|as\s+well\s+as|at\s+your\s+option)\b[\s,("'*]*){0,3}(?:(?:the|a|an)\s+)?""", re.I)
# a row without any of these has no statement
SIGN = TRIGGER + r"|under|spdx|rights[\W_]+reserved|public[\W_]+domain|creative[\W_]+commons|cc[\W_]+(?:by|attribution)|cc0|gpl|fdl|mpl|epl|eupl|cddl|odbl|bsl|wtfpl"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@functools.lru_cache(maxsize=1)
def prepared():
    alone = zstandard.ZstdCompressor(level=3)
    made = []
    for name, text in TEMPLATES.items():
        text = " ".join(text.split())
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        if not any(found.search(text) for found in NAMES.values()) or name.endswith("-notice"):
            made.append((name, words(text), zstandard.ZstdCompressor(level=3, dict_data=raw)))
    return alone, made


@functools.lru_cache(maxsize=1024)
def wording(text: str) -> tuple[list[str], zstandard.ZstdCompressor]:
    raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return words(text), zstandard.ZstdCompressor(level=3, dict_data=raw)


def license_of(family: str, found: re.Match) -> tuple[str, list[str]]:
    """The license that a name stands for, and its statements in usual words."""
    part = found.groupdict()
    v = part.get("v")
    full = None if v is None else v if "." in v else v + ".0"
    if family == "bsd":
        clauses = part["n"] or part["m"] or {"new": "3", "modified": "3", "revised": "3", "simplified": "2", "original": "4"}.get((part["kind"] or "").lower())
        return (f"bsd-{clauses}-clause" if clauses else "bsd"), [FAMILIES[family][1].format(n=f"{clauses}-Clause " if clauses else "")]
    shown = "" if full is None else f" {full}"
    if family == "cc-by":
        given = set(re.findall(r"nc|nd|sa|noncomm|noderiv|shareal", re.sub(r"[^a-z]", "", part["parts"].lower())))
        kinds = [(short, long) for short, long in CC_KINDS if short.lower() in given or long[:7].lower() in given]
        name = "-".join(["cc-by", *(short.lower() for short, _ in kinds)]) + ("" if full is None else f"-{full}")
        spelt = "-".join(["Attribution", *(long for _, long in kinds)])
        return name, [FAMILIES[family][1].format(parts="-".join(["BY", *(short for short, _ in kinds)]), v=shown), f"This work is licensed under a Creative Commons {spelt}{shown} International License."]
    name = family if full is None else f"{family}-{full}"
    if family == "cc0":
        return name, [FAMILIES[family][1].format(v=shown)]
    return name, [TEMPLATES.get(name) or FAMILIES[family][1].format(v="" if full is None else f", version {full.removesuffix('.0') if family.endswith('gpl') else full}")]


def names(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, license, statements in usual words) of each license that the text names as one, in order."""
    found, low = [], text.lower()
    for m in SPDX.finditer(text):
        known = re.sub(r"(?i)-(?:only|or-later)$", "", m[1])
        whole = next(((family, x) for family, name in NAMES.items() if (x := name.fullmatch(known))), None)
        name = license_of(*whole)[0] if whole else m[1].lower()
        found.append((m.start(1), m.end(1), 0, name, [f"SPDX-License-Identifier: {m[1]}"], True))
    for family, name in NAMES.items():
        for m in name.finditer(text) if any(key in low for key in KEYS[family]) else ():
            sure = "licen" in m[0].lower() or family in ("cc-by", "cc0", "all-rights-reserved", "public-domain") or (family.endswith("gpl") and (m["v"] is not None or "gnu" in m[0].lower()))
            found.append((*m.span(), 1, *license_of(family, m), sure or bool(GRANT.search(text, max(0, m.start() - 160), m.start()))))
    # an identifier counts as a whole, then the longest name at a place
    kept = []
    for one in sorted(found, key=lambda f: (f[2], f[0], -f[1])):
        at = bisect.bisect_left(kept, one)
        if (at == 0 or kept[at - 1][1] <= one[0]) and (at == len(kept) or one[1] <= kept[at][0]):
            kept.insert(at, one)
    sure = [k[5] for k in kept]
    joined = [a[1] < b[0] <= a[1] + 60 and bool(LISTED.fullmatch(text, a[1], b[0])) for a, b in zip(kept, kept[1:], strict=False)]
    for k in range(1, len(kept)):
        sure[k] = sure[k] or (sure[k - 1] and joined[k - 1])
    for k in range(len(kept) - 2, -1, -1):
        sure[k] = sure[k] or (sure[k + 1] and joined[k])
    return [(a, b, name, texts) for (a, b, _, name, texts, _), yes in zip(kept, sure, strict=True) if yes]


def saving(alone: zstandard.ZstdCompressor, given: zstandard.ZstdCompressor, block: str) -> float:
    """Share of the block's compressed size that the template saves."""
    data = block.lower().encode()
    size = len(alone.compress(data))
    return (size - len(given.compress(data))) / size


def differences(template: list[str], block: list[str], sure: tuple[int, int] = (0, 0)) -> tuple[list[str], list[str], int, int] | None:
    """(template words missing, words in their place, first and last matched word) of the best alignment; None if nothing matches.

    A matched run at an end takes part if it is as long as the words between it and the next one, or touches the words `sure`.
    """
    match = difflib.SequenceMatcher(None, block, template, autojunk=False)
    runs = [m for m in match.get_matching_blocks() if m.size]
    while len(runs) > 1:
        ends = [(runs[0], runs[1].a - runs[0].a - runs[0].size), (runs[-1], runs[-1].a - runs[-2].a - runs[-2].size)]
        stray = [m for m, gap in ends if m.size < gap and not (m.a < sure[1] and sure[0] < m.a + m.size)]
        if not stray:
            break
        runs.remove(min(stray, key=lambda m: m.size))
    if not runs:
        return None
    missing, added = template[: runs[0].b], []
    for one, two in zip(runs, runs[1:], strict=False):
        missing += template[one.b + one.size : two.b]
        added += block[one.a + one.size : two.a]
    return missing + template[runs[-1].b + runs[-1].size :], added, runs[0].a, runs[-1].a + runs[-1].size


def changed(missing: list[str], added: list[str]) -> int:
    """Differences, a word in the place of another counting once."""
    return max(len(missing), len(added))


def confirmed(wanted: list[str], tokens: list[str], first: int, last: int) -> tuple | None:
    """(score, first word, end, missing, added) of a notice within these words, a difference counting as five matched words; None if too much differs."""
    missing, added, start, end = differences(wanted, tokens[first:last]) or (wanted, [], 0, 0)
    n = changed(missing, added)
    return (len(wanted) - len(missing) - 5 * n, first + start, first + end, missing, added) if n <= MOST_CHANGED * len(wanted) else None


def notices(text: str, spans: list, tokens: list[str], ends: list[int]) -> list[tuple]:
    """(first word, end, license, saving, missing, added) of notices that do not overlap, the better one first where two would.

    A template's block is the words around a trigger word: as many before it as the template has, and a quarter more after.
    Every template that saves enough is compared, before and behind a notice found in the block as well, up to the trigger.
    """
    alone, templates = prepared()
    found, done = [], dict.fromkeys((name for name, *_ in templates), 0)
    for hit in re.finditer(TRIGGER, text):
        here = bisect.bisect_right(ends, hit.start())
        for name, wanted, given in templates if here < len(tokens) else ():
            first, last = max(done[name], here - len(wanted)), min(len(tokens), here + len(wanted) + len(wanted) // 4 + 2)
            while first <= here < last:
                # a word that the block does not have is missing in any alignment
                if len(set(wanted).difference(tokens[first:last])) > MOST_CHANGED * len(wanted):
                    break
                save = saving(alone, given, text[spans[first][0] : spans[last - 1][1]])
                one = confirmed(wanted, tokens, first, last) if save >= LEAST_SAVING else None
                if one is None:
                    break
                found.append((one, name, save, wanted))
                if one[1] > here:
                    last = one[1]
                else:
                    first = done[name] = one[2]
    once = {(f[1], f[0][1], f[0][2]): f for f in found}.values()
    kept, waiting = [], collections.deque(sorted(once, key=lambda f: (-f[0][0], f[0][1], f[1])))
    while waiting:
        one, name, save, wanted = waiting.popleft()
        _, a, b, missing, added = one
        other = over(kept, a, b)
        if other is None:
            bisect.insort(kept, (a, b, name, save, missing, added), key=lambda k: k[0])
            continue
        # what lies outside the better notice may still be one
        c, d = other[:2]
        for x, y in ((max(0, a - 1), c), (d, min(len(tokens), b + 1))):
            rest = confirmed(wanted, tokens, x, y) if y > x and (a < c or b > d) else None
            if rest and over(kept, rest[1], rest[2]) is None:
                waiting.append((rest, name, save, wanted))
    return kept


def over(kept: list[tuple], a: int, b: int) -> tuple | None:
    """One of the places (first, end, ...), in order and apart, that shares a word with a..b."""
    at = bisect.bisect_left(kept, b, key=lambda k: k[0])
    return kept[at - 1] if at and kept[at - 1][1] > a else None


def statements(text: str) -> list[tuple]:
    """(line, license, saving, exact, missing words, added words) of each statement, in order.

    A named license outside the notices is compared with its statement in usual words, between the statements before and
    after it. Statements do not overlap, and none hides one before or behind it.
    """
    named = names(text)
    if not named and not re.search(TRIGGER, text):
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    tokens, ends = [text[a:b].lower() for a, b in spans], [b for _, b in spans]
    out = notices(text, spans, tokens, ends)
    named = [(bisect.bisect_right(ends, a), bisect.bisect_left(ends, b) + 1, name, texts) for a, b, name, texts in named]
    # words that a notice matches name its license; words strange to it are a statement of their own
    inside = [over(out, a, b) for a, b, *_ in named]
    named = [n for n, o in zip(named, inside, strict=True) if o is None or set(tokens[n[0] : n[1]]) <= set(o[5])]
    alone = prepared()[0]
    borders = sorted([(a, b) for a, b, *_ in named] + [(a, b) for a, b, *_ in out])
    starts, stops = [a for a, _ in borders], sorted(b for _, b in borders)
    for a, b, name, texts in named:
        low, high = bisect.bisect_right(stops, a) - 1, bisect.bisect_left(starts, b)
        place = (a, b, stops[low] if low >= 0 else 0, starts[high] if high < len(starts) else len(tokens))
        out.append(closest(alone, text, spans, tokens, place, name, texts))
    return [(text.count("\n", 0, spans[a][0]), name, save, not missing and not added, missing, added) for a, _, name, save, missing, added in sorted(out, key=lambda o: o[:3])]


def closest(alone, text: str, spans: list, tokens: list[str], place: tuple, name: str, texts: list[str]) -> tuple:
    """(first word, end, license, saving, missing, added) of a named license beside the wording that differs least."""
    a, b, low, high = place
    best = None
    for shown in texts:
        wanted, given = wording(shown)
        first, last = max(low, a - len(wanted)), min(high, b + len(wanted))
        missing, added, start, end = differences(wanted, tokens[first:last], (a - first, b - first)) or (wanted, tokens[a:b], a - first, b - first)
        # the name is part of the statement, matched or not
        if first + start > a:
            added, start = tokens[a : first + start] + added, a - first
        if first + end < b:
            added, end = added + tokens[first + end : b], b - first
        save = saving(alone, given, text[spans[first + start][0] : spans[first + end - 1][1]])
        one = (-len(missing) - len(added), save, first + start, first + end, name, missing, added)
        best = one if best is None else max(best, one, key=lambda o: o[:2])
    _, save, start, end, name, missing, added = best
    return start, end, name, save, missing, added


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, line, license, saving, exact, missing, added: a row for each statement in each row of `docs` (doc_id, text).

    `line` counts from 0; `missing` and `added` are the words by which the statement differs from its template. Null and empty
    texts have none. Repeated rows are reported each. Texts of any length are read whole; an empty table gives none.
    """
    schema = "doc_id long, line int, license string, saving double, exact boolean, missing array<string>, added array<string>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in statements(t)]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
        columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    some = docs.where(F.col("text").rlike(SIGN)).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_texts(some, "text", schema, run)
