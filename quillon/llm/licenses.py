"""License scans by sentence rules.

A text is normalised and cut into segments: at each line's end, and after each of
``. ! ? ; :`` with white space.  A normalised segment is its words of a-z and
digits, so comment marks, bullets, quotes and indentation vanish, and a line
without words is an empty segment.  A sentence is a run of segments between which
no segment is empty: a known sentence may thus be wrapped over the lines of a
paragraph in any way, hold an abbreviation or a colon, or be one line of it, but
it never reaches over a blank line.

Where a run of segments begins as a known sentence does, the runs from there on, up
to the length of the longest known one, are looked up in a map from sentences to
identifiers.  The map is cut by checksum into parts of a few sentences, so a look-up
does not hang on how many are known.  Sentences are taken from the left, the longest
where several begin.  The identifiers of a document, in order, are then matched
against licence rules, which are ordered sequences of identifiers: other sentences
between them do not matter, other identifiers do.  A sequence with which a longer
one of another licence begins counts only where that one is not.

All of it is narrow: a row never leaves its task, so a frequent licence line
costs no shuffle.  Texts without any word that each known sentence has one of
are told apart first.  No pattern goes over a stretch of a text twice, so time is
in proportion to a text's length, whatever is in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import plain
from quillon.llm.native import LOWER, UPPER, ascii_lower

#: Known sentences (normalised) and their identifiers, by licence.
SENTENCES = {
    # Apache 2.0
    "licensed under the apache license version 2 0": "apache-licensed",
    "licensed under the apache license version 2 0 the license": "apache-licensed",
    "this project is licensed under the apache license version 2 0": "apache-licensed",
    "this file is licensed to you under the apache license version 2 0 the license": "apache-licensed",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "apache-foundation",
    "see the notice file distributed with this work for additional information regarding copyright ownership": "apache-notice",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache-licensed",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-unless",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    # MIT
    "released under the mit license": "mit-released",
    "licensed under the mit license": "mit-released",
    "this software is released under the mit license": "mit-released",
    "this project is licensed under the mit license": "mit-released",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liable",
    # ISC
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liable",
    # BSD
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liable",
    "licensed under the bsd 3 clause license": "bsd3-licensed",
    "licensed under the bsd 2 clause license": "bsd2-licensed",
    # GNU
    "this work is licensed under the gnu general public license version 3": "gpl3-work",
    "this work is licensed under the gnu general public license version 2": "gpl2-work",
    "licensed under the gnu general public license version 3": "gpl3-work",
    "licensed under the gnu general public license version 2": "gpl2-work",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "gpl3-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "licensed under the gnu lesser general public license version 3": "lgpl3-licensed",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-free",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-free",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-hope",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-received",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-free",
    "see the gnu affero general public license for more details": "agpl-see",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-received",
    # Mozilla
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-obtain",
    # Creative Commons and others
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4",
    "licensed under cc by nd 4 0": "cc-by-nd-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "boost-distributed",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1-terms",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl-subject",
    "the contents of this file are subject to the terms of the common development and distribution license": "cddl-subject",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedicated",
    "licensed under cc0 1 0": "cc0-licensed",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "licensed under the artistic license 2 0": "artistic2-licensed",
    "this library is free software you can redistribute it and or modify it under the same terms as perl itself": "perl-terms",
    "this program is free software you can redistribute it and or modify it under the same terms as perl itself": "perl-terms",
    "all rights reserved": "all-rights-reserved",
}
#: Fixed values: (licence, identifiers in order).
RULES = (
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0-header", ("apache-licensed", "apache-compliance", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0-header", ("apache-licensed", "apache-compliance", "apache-copy", "apache-see")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-text", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("ISC", ("isc-grant",)),
    ("ISC-text", ("isc-grant", "isc-as-is", "isc-liable")),
    ("BSD-2-Clause", ("bsd2-licensed",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-licensed",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("GPL-2.0", ("gpl2-work",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-or-later-header", ("gpl2-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-3.0-or-later-header", ("gpl3-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0", ("lgpl3-licensed",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("MPL-2.0-header", ("mpl2-subject", "mpl2-obtain")),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-distributed",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("CDDL", ("cddl-subject",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("CC0-1.0", ("cc0-licensed",)),
    ("0BSD", ("0bsd-grant",)),
    ("Artistic-2.0", ("artistic2-licensed",)),
    ("Artistic-1.0-Perl", ("perl-terms",)),
    ("Proprietary", ("all-rights-reserved",)),
)
#: Each known sentence has one of these words (checked below).
ANCHORS = ("licen", "copyright", "permission", "rights", "redistribution", "software", "liable", "advertising", "distribut")
assert all(any(a in s for a in ANCHORS) for s in SENTENCES)
#: White space within a line; a line's end, and what begins the next line before its first word.
_BLANKS, _LINE = r"[ \t\x0b\x0c\r]+", r" ?\n[^A-Za-z0-9\n]*"
#: A segment ends at a line's end, or after one of these marks and white space.
_END = r"([.!?;:]) "
#: Words that begin lines as comment marks.
_MARK = r"(^|\n) ?(?:rem|dnl) "
#: Words of the longest known sentence, and first two words of each.
MOST_WORDS = max(len(s.split()) for s in SENTENCES)
OPENINGS = sorted({" ".join(s.split()[:2]) for s in SENTENCES})
#: Parts of the map, a few sentences each.
PARTS = 1 << (len(SENTENCES) // 4).bit_length()


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, also where ``f`` uses it in lambdas."""
    return F.get(F.transform(F.array(x), f), 0)


def segments(text: Column) -> Column:
    """The normalised segments of a text, in order."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _BLANKS, " "), _LINE, "\n"), _END, "$1\n")
    words = F.regexp_replace(F.regexp_replace(ascii_lower(cut), "[^a-z0-9\n]+", " "), _MARK, "$1")
    return F.transform(F.split(words, "\n", -1), lambda s: F.btrim(s, F.lit(" ")))


def known(sentence: Column) -> Column:
    """The identifier of a normalised sentence, or null."""
    parts: list[list[Column]] = [[] for _ in range(PARTS)]
    for s, i in SENTENCES.items():
        parts[zlib.crc32(s.encode()) % PARTS] += [F.lit(s), F.lit(i)]
    maps = F.array(*(F.create_map(*p) if p else F.create_map().cast("map<string,string>") for p in parts))
    return F.try_element_at(F.get(maps, (F.crc32(sentence) % PARTS).cast("int")), sentence)


def _longest(segs: Column, at: Column) -> Column:
    """``at``, ``to`` and ``sid`` of the longest known sentence that begins with a
    segment, ``sid`` null if there is none."""

    def runs(near: Column) -> Column:
        """Of the segments up to the end of the paragraph."""
        end = F.array_position(near, F.lit(""))
        count = F.when(end > 0, end - 1).otherwise(F.size(near)).cast("int")
        tried = F.transform(F.sequence(F.lit(1), count), lambda n: F.struct((at + n - 1).alias("to"), known(F.array_join(F.slice(near, F.lit(1), n), " ")).alias("sid")))
        return F.element_at(F.concat(F.array(F.struct(at.alias("to"), F.lit(None).cast("string").alias("sid"))), F.filter(tried, lambda x: x["sid"].isNotNull())), -1)

    return let(let(F.slice(segs, at + 1, F.lit(MOST_WORDS)), runs), lambda x: F.struct(at.alias("at"), x["to"].alias("to"), x["sid"].alias("sid")))


def sentences(segs: Column) -> Column:
    """The known sentences of a text, from the left and not overlapping: ``at``,
    ``to`` (segments) and ``sid``."""

    def found(segs: Column) -> Column:
        opens = lambda i: F.substring_index(F.array_join(F.slice(segs, i + 1, F.lit(2)), " "), " ", 2).isin(OPENINGS)
        starts = F.filter(F.sequence(F.lit(0), F.size(segs) - 1), opens)
        hits = F.filter(F.transform(starts, lambda i: _longest(segs, i)), lambda x: x["sid"].isNotNull())
        none = F.filter(hits, lambda _: F.lit(False))
        free = lambda kept, x: (F.size(kept) == 0) | (x["at"] > F.element_at(F.concat(F.array(x), kept), -1)["to"])
        return F.aggregate(hits, none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))

    return let(segs, found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row in which a known sentence occurs: ``id_col``, ``n_sentences``
    (known ones, long), ``sentence_ids`` (their identifiers in order, joined by
    commas), ``first_sentence`` (segments before the first, long) and ``licenses``
    (names of the rules found, sorted, joined by commas; empty if no rule's sequence
    is there).

    Rows with a null or empty text or without a known sentence have no result;
    repeated rows have one each; further columns are left out."""
    text = F.col("text")
    anchored = let(F.lower(text), lambda x: F.exists(F.array(*map(F.lit, ANCHORS)), lambda a: F.contains(x, a)))
    docs = plain(df, id_col, text_col).toDF("id", "text").filter(text.isNotNull() & anchored)
    hits = docs.select("id", sentences(segments(text)).alias("found")).filter(F.size("found") > 0).select("id", F.col("found.sid").alias("sids"), F.get("found", 0)["at"].alias("first"))
    return hits.select(
        F.col("id").alias(id_col),
        F.size("sids").cast("long").alias("n_sentences"),
        F.array_join("sids", ",").alias("sentence_ids"),
        F.col("first").cast("long").alias("first_sentence"),
        _licenses(F.col("sids")).alias("licenses"),
    )


def _marked(sequence: tuple[str, ...]) -> str:
    """A sequence as text in which no two identifiers share a mark."""
    return "".join(f",{i}," for i in sequence)


def _longer(name: str, sequence: tuple[str, ...]) -> list[str]:
    """Sequences of other licences that begin with this one: where they are, this
    one does not count.  A name that goes on (``MIT-text``) is no other licence."""
    return [_marked(q) for n, q in RULES if not n.startswith(name) and len(q) > len(sequence) and q[: len(sequence)] == sequence]


def _licenses(sids: Column) -> Column:
    by_name: dict[str, Column] = {}
    whole = F.concat(F.lit(","), F.array_join(sids, ",,"), F.lit(","))
    for name, sequence in sorted(RULES):
        left = whole
        for q in _longer(name, sequence):
            left = F.replace(left, F.lit(q), F.lit(",-,"))
        fits = left.contains(_marked(sequence))
        by_name[name] = by_name[name] | fits if name in by_name else fits
    return F.concat_ws(",", *(F.when(fits, F.lit(name)) for name, fits in by_name.items()))


def sql() -> str:
    names: dict[str, list[str]] = {}
    for name, sequence in sorted(RULES):
        left = "ids"
        for q in _longer(name, sequence):
            left = f"replace({left}, '{q}', ',-,')"
        names.setdefault(name, []).append(f"contains({left}, '{_marked(sequence)}')")
    licenses = ", ".join(f"CASE WHEN {' OR '.join(fits)} THEN '{name}' END" for name, fits in names.items())
    low = f"translate(regexp_replace(regexp_replace(regexp_replace(text, '{_BLANKS}', ' ', 'g'), '{_LINE}', chr(10), 'g'), '{_END}', '\\1' || chr(10), 'g'), '{UPPER}', '{LOWER}')"
    words = f"regexp_replace(regexp_replace({low}, '[^a-z0-9\n]+', ' ', 'g'), '{_MARK}', '\\1', 'g')"
    return f"""
WITH RECURSIVE k(s, sid) AS (VALUES {", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())}),
c AS (SELECT row_number() OVER () AS r, doc_id, list_transform(string_split({words}, chr(10)), lambda x: trim(x, ' ')) AS segs FROM documents WHERE text IS NOT NULL),
i AS (SELECT r, segs, unnest(generate_series(1, len(segs))) AS pos FROM c),
o AS (SELECT * FROM i WHERE array_to_string(string_split(array_to_string(segs[pos:pos + 1], ' '), ' ')[1:2], ' ') IN ({", ".join(f"'{x}'" for x in OPENINGS)})),
n AS (SELECT r, pos, segs[pos:pos + {MOST_WORDS} - 1] AS near, unnest(generate_series(1, {MOST_WORDS})) AS n FROM o),
h AS (SELECT r, pos, pos + n - 1 AS upto, sid FROM n JOIN k ON k.s = array_to_string(near[1:n], ' ') WHERE n <= len(near) AND NOT list_contains(near[1:n], '')),
b AS (SELECT r, pos, max(upto) AS upto, arg_max(sid, upto) AS sid FROM h GROUP BY r, pos),
x AS (SELECT b.*, t.pos AS next FROM b ASOF LEFT JOIN b t ON b.r = t.r AND b.upto < t.pos),
g(r, pos, sid, next) AS (SELECT r, pos, sid, next FROM x WHERE (r, pos) IN (SELECT (r, min(pos)) FROM x GROUP BY r) UNION ALL SELECT x.r, x.pos, x.sid, x.next FROM g JOIN x ON x.r = g.r AND x.pos = g.next),
f AS (SELECT r, count(*) AS n_sentences, string_agg(sid, ',' ORDER BY pos) AS sentence_ids, string_agg(',' || sid || ',', '' ORDER BY pos) AS ids, min(pos) - 1 AS first_sentence FROM g GROUP BY r)
SELECT doc_id, n_sentences, sentence_ids, first_sentence, concat_ws(',', {licenses}) AS licenses FROM f JOIN c USING (r)
"""
