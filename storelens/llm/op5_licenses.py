"""License scan: Dice coefficient over word bigrams against licence notices.

A text's units are its lines, the whole text and windows of its words.  A unit is lower-cased and cut
into words of letters and digits; its set is its distinct word bigrams.  For a
threshold t only templates whose set size lies within t / (2 - t) and
(2 - t) / t times the unit's can reach it, so the others are pruned by size before any
intersection.  The best template of a unit at or above t is its match (ties: the
template listed first).

Windows find notices that are wrapped over lines of a longer text or stand inside a
line.  Their words are those of the whole text, and every window whose number of
bigrams lies within the bounds above of a template's counts (a best one starts and ends
with a bigram of the template).  Of the windows that reach t the best are taken first,
none overlapping another (ties: the larger template, the template listed first, the
earlier window, the shorter one).  Windows that only repeat the match of a line that
they touch, or of the whole text, are left out.  Texts are pruned exactly: a window at
t has at least t / (2 - t) of the template's bigrams, so it has one of any few more than
the rest, and those made of the most letters are looked for.

Everything is a Spark expression inside one row, so nothing is shuffled.

Cases: null and empty texts and units of fewer than two words match nothing;
repeated rows repeat; texts are scanned whole; a text of one line is one unit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import text_or_empty

THRESHOLD = 0.8

# Public licence notices, short texts whole, of long texts (-text of GPL, LGPL, AGPL, Apache, MPL, EPL) the opening.
# A template's name is the licence with its version and, after it, the kind of wording.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version."),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."),
    "GPL-2.0-text": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 "
        "Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim "
        "copies of this license document, but changing it is not allowed."),
    "LGPL-2.1-text": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, "
        "Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed."),
    "GPL-3.0-text": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but "
        "changing it is not allowed."),
    "LGPL-3.0-text": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but "
        "changing it is not allowed."),
    "AGPL-3.0-text": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but "
        "changing it is not allowed."),
    "Apache-2.0-text": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION"),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-Clause-short": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."),
    "ISC-short": "Released under the ISC License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."),
    "MPL-1.1-notice": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
        "this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.mozilla.org/MPL/"),
    "MPL-1.1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "MPL-2.0-text": (
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that "
        "creates, contributes to the creation of, or owns Covered Software."),
    "EPL-1.0": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License v1.0 which accompanies this distribution"),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "EPL-1.0-text": (
        "Eclipse Public License - v 1.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC "
        "LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE "
        "OF THIS AGREEMENT."),
    "EPL-2.0-text": (
        "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC "
        "LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE "
        "OF THIS AGREEMENT."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International "
        "License."),
    "CC-BY-3.0": "Licensed under CC BY 3.0.",
    "CC-BY-3.0-notice": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.",
    "CC-BY-SA-3.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
}

#: What separates words; letters and digits of any script stay.
BREAKS = r"[^\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template."""
    words = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _chain(words: Column) -> Column:
    """All bigrams in order, repeated ones too."""
    joined = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(joined, lambda x: x.isNotNull())


def _pairs(words: Column) -> Column:
    return F.array_distinct(_chain(words))


def _strings(values: list[str]) -> Column:
    """A constant array of bigrams, sent as one text."""
    return F.split(F.lit("\n".join(values)), "\n")


def _before(chain: Column) -> Column:
    """For every bigram of a text, where the same one stands next before it, -1 if nowhere; found by sorting."""
    sorted_ = F.array_sort(F.transform(chain, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    shifted = lambda s: F.concat(F.array(F.struct(F.lit(None).cast("string").alias("x"), F.lit(-1).alias("i"))), F.slice(s, 1, F.size(s) - 1))
    paired = _let(sorted_, lambda s: F.zip_with(s, shifted(s), lambda a, b: F.struct(
        a["i"].alias("i"), F.when(a["x"] == b["x"], b["i"]).otherwise(F.lit(-1)).alias("before"))))
    return F.transform(F.array_sort(paired), lambda p: p["before"])


def _best_window(marked: Column, start: Column, t: Column, threshold: float) -> Column:
    """The best window from a bigram on for a template, or null below the threshold.

    ``marked`` has, for every bigram of the text, where it stands before and whether the
    template has it: a bigram is counted where it is the window's first.
    """
    def longer(a: Column, p: Column) -> Column:
        new = (p["before"] < start).cast("int")
        hits, size, end = a["hits"] + new * p["hit"], a["size"] + new, a["end"] + 1
        dice = 2.0 * hits / (size + t["n"])
        return F.struct(hits.alias("hits"), size.alias("size"), end.alias("end"), F.greatest(a["dice"], dice).alias("dice"),
                        F.when(dice > a["dice"], end).otherwise(a["len"]).alias("len"))

    zero = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("size"), F.lit(0).alias("end"), F.lit(0.0).alias("dice"), F.lit(0).alias("len"))
    return _let(F.aggregate(F.slice(marked, start + 1, t["most"]), zero, longer), lambda b: F.when(b["dice"] >= threshold, F.struct(
        (-b["dice"]).alias("cost"), (-t["n"]).alias("small"), t["order"].alias("order"), start.alias("start"),
        b["len"].alias("len"), t["license"].alias("license"))))


def _windows(chain: Column, sets: list[tuple[str, list[str]]], spans: list[int], threshold: float) -> Column:
    """``(cost, small, order, start, len, license)`` of the windows taken, ``cost`` the negative coefficient;
    null for texts that are pruned."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows, rare = [], []
    for i, (name, b) in enumerate(sets):
        need = math.ceil(low * len(b) - 1e-9)
        rare += sorted(b, key=len, reverse=True)[:len(b) - need + 1]
        rows.append(F.struct(F.lit(i).alias("order"), F.lit(name).alias("license"), F.lit(len(b)).alias("n"), F.lit(need).alias("need"),
                             F.lit(math.floor(high * spans[i] + 1e-9)).alias("most"), _strings(b).alias("grams")))
    every = _strings(list(dict.fromkeys(x for _, b in sets for x in b)))

    def of_template(t: Column, before: Column) -> Column:
        mark = F.zip_with(chain, before, lambda x, b: F.struct(b.alias("before"), F.array_contains(t["grams"], x).cast("int").alias("hit")))

        def found(marked: Column) -> Column:
            hits = F.filter(F.transform(marked, lambda p, i: F.when(p["hit"] == 1, i)), lambda i: i.isNotNull())
            dense = _let(hits, lambda h: F.filter(h, lambda p, k: F.coalesce(F.get(h, k + t["need"] - 1) - p < t["most"], F.lit(False))))
            return F.filter(F.transform(dense, lambda p: _best_window(marked, p, t, threshold)), lambda w: w.isNotNull())

        return _let(mark, found)

    def take(taken: Column, w: Column) -> Column:
        # A window of n bigrams has n + 1 words.
        overlaps = F.exists(taken, lambda v: (v["start"] <= w["start"] + w["len"]) & (w["start"] <= v["start"] + v["len"]))
        return F.when(overlaps, taken).otherwise(F.concat(taken, F.array(w)))

    present = F.array_intersect(chain, every)
    near = _let(present, lambda p: F.filter(F.array(*rows), lambda t: F.size(F.array_intersect(t["grams"], p)) >= t["need"]))
    ranked = _let(_before(chain), lambda b: F.array_sort(F.flatten(F.transform(near, lambda t: of_template(t, b)))))
    taken = _let(ranked, lambda r: F.aggregate(r, F.slice(r, 1, 0), take))
    return F.when(F.arrays_overlap(chain, _strings(list(dict.fromkeys(rare)))), taken)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, matches)``: one row per row of ``docs``.

    ``matches`` lists ``(unit, license, dice)`` of the matching units: the line
    number from 0, or -1 for the whole text; then of the windows in their order,
    with the number of the line in which they start.
    """
    named = TEMPLATES if templates is None else templates
    sets = [(name, bigrams(t)) for name, t in named.items()]
    spans = [len(_words(t)) - 1 for t in named.values()]
    # A little wider than the quotients, which may round past a whole number: sizes at the bounds still reach the threshold.
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    least = min(len(b) for _, b in sets) * low
    most = max(len(b) for _, b in sets) * high

    # As for windows: a unit at the threshold has one of these bigrams.
    rare = _strings(list(dict.fromkeys(x for _, b in sets for x in sorted(b, key=len, reverse=True)[:len(b) - math.ceil(low * len(b)) + 1])))

    def best(pairs: Column) -> Column:
        size = F.size(pairs)
        scores = [F.when((size >= low * len(b)) & (size <= high * len(b)),
                         F.struct((2.0 * F.size(F.array_intersect(pairs, F.array(*map(F.lit, b)))) / (size + len(b))).alias("dice"),
                                  F.lit(-i).alias("order"), F.lit(name).alias("license")))
                  for i, (name, b) in enumerate(sets)]
        return F.array_max(F.array(*scores))

    def match(words: Column, unit: Column) -> Column:
        # A set is no larger than the words less one: too short units are pruned before their bigrams are made.
        found = F.when(F.size(words) - 1 >= least, _let(
            _pairs(words), lambda p: F.when((F.size(p) >= least) & (F.size(p) <= most) & F.arrays_overlap(p, rare), best(p))))
        return _let(found, lambda m: F.when(m["dice"] >= threshold, F.struct(
            unit.cast("int").alias("unit"), m["license"].alias("license"), m["dice"].alias("dice"))))

    words = lambda line: F.filter(F.split(F.regexp_replace(F.lower(line), BREAKS, " "), " "), lambda w: w != "")
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.transform(F.split(text_or_empty(text), "\n"), words).alias("lines"))
    by_line = F.transform("lines", lambda w, i: match(w, i))
    whole = lambda text: F.when(F.size("lines") > 1, match(text, F.lit(-1)))

    def with_windows(text: Column, units: Column) -> Column:
        # The line of each word; made only for texts with windows.
        place = F.flatten(F.transform("lines", lambda w, i: F.array_repeat(i, F.size(w))))

        def added(windows: Column, line_of: Column) -> Column:
            placed = F.transform(windows, lambda w: F.struct(
                w["start"].alias("start"), F.get(line_of, w["start"]).alias("unit"), F.get(line_of, w["start"] + w["len"]).alias("last"),
                w["license"].alias("license"), (-w["cost"]).alias("dice")))
            own = F.filter(placed, lambda w: ~F.exists(units, lambda m: (m["license"] == w["license"]) & (
                (m["unit"] == -1) | m["unit"].between(w["unit"], w["last"]))))
            return F.transform(F.array_sort(own), lambda w: F.struct(
                w["unit"].cast("int").alias("unit"), w["license"].alias("license"), w["dice"].alias("dice")))

        windows = _let(_chain(text), lambda c: _windows(c, sets, spans, threshold))
        return _let(windows, lambda ws: F.when(F.size(ws) > 0, F.concat(units, _let(place, lambda p: added(ws, p)))).otherwise(units))

    matches = _let(F.flatten("lines"), lambda t: _let(
        F.filter(F.concat(by_line, F.array(whole(t))), lambda m: m.isNotNull()), lambda units: with_windows(t, units)))
    return lines.select("doc_id", matches.alias("matches"))


def license_digest(found: DataFrame) -> DataFrame:
    """Per document: number of matching units, best license with its Dice coefficient, all licenses."""
    top = F.array_max(F.transform("matches", lambda m: F.struct(
        m["dice"].alias("dice"), (-m["unit"]).alias("u"), m["license"].alias("license"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), top["license"].alias("license"),
                        F.round(top["dice"], 6).alias("dice"), names.alias("licenses"))
