"""Licence scan: Dice coefficient over word bigrams between windows of normalised text and licence templates."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import WORD, arrow_map, id_of

#: name: (licence, words in lower case). Short grants as they are written in headers and on pages, notices, and full texts
#: of the short licences, without titles and copyright lines.
TEMPLATES: dict[str, tuple[str, str]] = {
    "apache-2.0": ("apache-2.0", "licensed under the apache license version 2 0"),
    "apache-2.0-notice": ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in
        writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
        implied see the license for the specific language governing permissions and limitations under the license"""),
    "gpl-3.0": ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    "gpl-2.0": ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    "gpl-3.0-notice": ("gpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the
        hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see
        the gnu general public license for more details"""),
    "gpl-2.0-notice": ("gpl-2.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the
        hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see
        the gnu general public license for more details"""),
    "gpl-notice": ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation"""),
    "lgpl-notice": ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
        published by the free software foundation"""),
    "agpl-3.0": ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    "agpl-notice": ("agpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as
        published by the free software foundation"""),
    "mit": ("mit", "released under the mit license"),
    "mit-text": ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
        sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
        conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the
        software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness
        for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
        software"""),
    "bsd": ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    "bsd-2-clause-text": ("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and
        any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
        disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential
        damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however
        caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of
        the use of this software even if advised of the possibility of such damage"""),
    "bsd-3-clause": ("bsd-3-clause", "licensed under the bsd 3 clause license"),
    "bsd-3-clause-text": ("bsd-3-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the
        copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
        merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any
        direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
        including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    "isc": ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "isc-text": ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
        above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with
        regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special
        direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    "zlib-text": ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
        alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not
        claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be
        appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original
        software 3 this notice may not be removed or altered from any source distribution"""),
    "mpl-2.0-notice": ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
        file you can obtain one at http mozilla org mpl 2 0"""),
    "mpl-2.0": ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    "cc-by-nc-4.0": ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    "cc-by-4.0": ("cc-by-4.0", "licensed under cc by 4 0"),
    "cc-by-sa-4.0": ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    "cc-by-4.0-notice": ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-sa-4.0-notice": ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc0-1.0": ("cc0-1.0", "to the extent possible under law the author has waived all copyright"),
    "unlicense": ("unlicense", "this is free and unencumbered software released into the public domain"),
    "unlicense-text": ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in
        jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the
        public domain"""),
    "boost-1.0": ("boost-1.0", "distributed under the boost software license version 1 0"),
    "boost-1.0-text": ("boost-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative
        works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in
        the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all
        copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of
        machine executable object code generated by a source language processor"""),
}
THRESHOLD = 0.75


class Template:
    def __init__(self, name: str, license_: str, text: str, threshold: float):
        words = text.split()
        self.name, self.license, self.words = name, license_, len(words)
        self.grams = frozenset(zip(words, words[1:]))
        #: Fewest bigrams of the template that a window must have: with s of its own o, Dice is 2s/(o+n), and o is s at least.
        self.least = math.ceil(threshold * len(self.grams) / (2 - threshold) - 1e-9)


def compiled(templates: dict[str, tuple[str, str]], threshold: float) -> list[Template]:
    return [Template(k, license_, text, threshold) for k, (license_, text) in sorted(templates.items())]


def best_window(pairs: list[tuple[str, str]], t: Template) -> tuple[float, int]:
    """(Dice, first word) of the window of as many words as the template, or all if there are fewer, that is most like it;
    the first of equals. Counts change by one bigram in and one out at each step."""
    width = min(t.words - 1, len(pairs))
    count: Counter = Counter()
    shared = 0
    best = (-1.0, 0)
    for i, p in enumerate(pairs):
        if i >= width:
            old = pairs[i - width]
            count[old] -= 1
            if not count[old]:
                del count[old]
                shared -= old in t.grams
        if not count[p]:
            shared += p in t.grams
        count[p] += 1
        if i >= width - 1:
            d = 2 * shared / (len(count) + len(t.grams))
            if d > best[0]:
                best = d, i - width + 1
    return best


def scan_text(text: str, templates: list[Template], where: dict[tuple[str, str], list[int]], threshold: float) -> list[tuple[str, str, int, int, float]]:
    """(licence, template, first word, words, Dice) of each template that some window reaches.

    A template is compared only if the text has as many of its bigrams as its size asks for. A hit that overlaps a better
    one of another licence is none.
    """
    words = WORD.findall(text.lower())
    pairs = list(zip(words, words[1:]))
    hits = Counter(i for p in where.keys() & set(pairs) for i in where[p])
    found = []
    for i, n in sorted(hits.items()):
        t = templates[i]
        if n >= t.least:
            d, at = best_window(pairs, t)
            if d >= threshold:
                found.append((t.license, t.name, at, min(t.words, len(words)), d))
    beaten = lambda a: any(b[0] != a[0] and b[4] > a[4] and b[2] < a[2] + a[3] and a[2] < b[2] + b[3] for b in found)
    return [a for a in found if not beaten(a)]


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, license, template, first_word, n_words, dice): licences found in each row's text, one row for each template.

    Every window of a text of as many words as the template has is compared, wherever lines are broken; of a shorter text
    all of it. The window with the highest Dice counts, the first of equals. Where windows of two licences overlap, the one
    with the lower Dice is dropped. Null, empty and wordless texts give no rows; a null doc_id stays null; repeated rows
    give repeated results; other columns aren't read. Long texts count in full. No table rows, no result rows. doc_id is
    read as a whole number. Nothing is shuffled.
    """
    known = compiled(TEMPLATES if templates is None else templates, threshold)
    where: dict[tuple[str, str], list[int]] = {}
    for i, t in enumerate(known):
        for g in t.grams:
            where.setdefault(g, []).append(i)

    def step(b: pa.RecordBatch) -> list:
        out = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t:
                out += [(i, *x) for x in scan_text(t, known, where, threshold)]
        if not out:
            return []
        i, k, n, u, w, d = zip(*out)
        return [pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k), pa.array(n), pa.array(u, pa.int32()), pa.array(w, pa.int32()), pa.array(d)], ["doc_id", "license", "template", "first_word", "n_words", "dice"])]

    return arrow_map(docs.select(id_of(docs), "text"), step, "doc_id long, license string, template string, first_word int, n_words int, dice double")


def license_sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL."""
    rows = ", ".join(f"('{k}', '{name}', '{' '.join(text.split())}')" for name, (k, text) in sorted(TEMPLATES.items()))
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: ({w})[i] || ' ' || ({w})[i + 1]))"
    return f"""
    WITH t0(license, template, body) AS (VALUES {rows}),
    t1 AS (SELECT license, template, string_split(body, ' ') AS w FROM t0),
    t AS (SELECT license, template, len(w) AS m, {grams("w")} AS g FROM t1),
    d0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents WHERE text IS NOT NULL),
    d AS (SELECT r, doc_id, w, {grams("w")} AS g FROM d0 WHERE len(w) > 1),
    c AS (SELECT r, doc_id, license, template, m, t.g AS tg, w, least(m, len(w)) AS k FROM d, t WHERE 2 * len(list_intersect(d.g, t.g)) >= {threshold} * (len(list_intersect(d.g, t.g)) + len(t.g))),
    x AS (SELECT r, doc_id, license, template, tg, k, i, w[i:i + k - 1] AS v FROM c, unnest(range(1, len(w) - k + 2)) AS q(i)),
    y AS (SELECT r, doc_id, license, template, tg, k, i, {grams("v")} AS g FROM x),
    s AS (SELECT r, doc_id, license, template, i - 1 AS a, k, 2 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM y),
    p AS (SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY dice DESC, a) AS n FROM s WHERE dice >= {threshold}),
    b AS (SELECT * FROM p WHERE n = 1)
    SELECT doc_id, license, template, CAST(a AS INTEGER) AS first_word, CAST(k AS INTEGER) AS n_words, CAST(dice AS DOUBLE) AS dice FROM b
    WHERE NOT EXISTS (SELECT 1 FROM b AS o WHERE o.r = b.r AND o.license <> b.license AND o.dice > b.dice AND o.a < b.a + b.k AND b.a < o.a + o.k)"""
