import random
import textwrap
import time

import duckdb
import pytest

from quillon.llm import licenses

#: Official notices, by the rules that they must be found by.
OFFICIAL = {
    "MIT,MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC,ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "MPL-2.0,MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0-or-later,GPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0-or-later,GPL-2.0-or-later-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "Apache-2.0,Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}


def wrapped(text, width, mark):
    parts = [textwrap.fill(p, width) if width else p for p in text.split("\n\n")]
    return "\n".join(f"{mark}{line}" for line in "\n\n".join(parts).split("\n"))


def both(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("arrow_documents", df.toArrow())
    con.sql("CREATE VIEW documents AS SELECT * FROM arrow_documents")
    got = sorted(map(tuple, licenses.scan(df).collect()), key=repr)
    assert got == sorted(con.sql(licenses.sql()).fetchall(), key=repr)
    return got


def test_official_texts_however_wrapped(spark):
    rows, want = [], []
    for names, text in OFFICIAL.items():
        for width in (0, 40, 72, 79):
            for mark in ("", "# ", " * ", "// ", ";; ", "    "):
                for end in ("\n", "\r\n"):
                    body = f"Copyright (c) 2020 Somebody\n\n{wrapped(text, width, mark)}\n\nint main() {{ return 0; }}"
                    rows.append((len(rows), body.replace("\n", end)))
                    want.append(names)
    got = both(spark, rows)
    assert {r[0]: r[4] for r in got} == dict(enumerate(want))
    assert {r[3] for r in got} == {2}


def test_sentences_do_not_reach_over_blank_lines(spark):
    rows = [(1, "Released under\n\nthe MIT license."), (2, "Released under\nthe MIT license."), (3, "It is released under the MIT license."), (4, "Words.\nReleased under the MIT license\nother words"), (5, "released under the mit license and more")]
    assert [r[0] for r in both(spark, rows)] == [2, 4]


def test_sequences(spark):
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    names = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    one = [grant, source, binary]
    rows = [(1, "\n".join(one)), (2, "\n".join([*one, "Other words.", names])), (3, "\n".join([grant, binary, source])), (4, "\n".join([grant, source, "All rights reserved.", binary])), (5, "\n".join([*one, names, "x", *one])), (6, names)]
    got = {r[0]: r[4] for r in both(spark, rows)}
    assert got == {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "", 4: "Proprietary", 5: "BSD-2-Clause,BSD-3-Clause", 6: ""}
    twice = "\n".join([*one, names] * 2)
    assert both(spark, [(1, twice)])[0][4] == "BSD-3-Clause"


def test_comment_words(spark):
    rows = [(1, "REM Licensed under the MIT License"), (2, "dnl Redistribution and use in source and binary forms, with or without\ndnl modification, are permitted provided that the following conditions are met:"), (3, "remedy licensed under the MIT license")]
    assert [(r[0], r[2]) for r in both(spark, rows)] == [(1, "mit-released"), (2, "bsd-grant")]


def test_time_is_linear(spark):
    """Megabytes of white space, marks, line ends, openings."""
    long = ["license " + x * (4_000_000 // len(x)) + "\nReleased under the MIT license." for x in (" ", "\t \r", "*", "\n", "\n ", ". ", "a b c ", "all\n")]
    start = time.time()
    got = licenses.scan(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()
    assert [r.licenses for r in sorted(got)] == ["MIT"] * len(long)
    assert time.time() - start < 60


def test_other_licences(spark):
    rows = [
        (1, "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
        (2, "// Distributed under the Boost Software License, Version 1.0."),
        (3, "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"),
        (4, "The contents of this file are subject to the terms of the\nCommon Development and Distribution License (the \"License\")."),
        (5, "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
        (6, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ]
    assert [r[4] for r in both(spark, rows)] == ["Zlib", "BSL-1.0", "EPL-2.0", "CDDL", "CC0-1.0", "0BSD"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_mixtures_agree_with_sql(spark, seed):
    rng = random.Random(seed)
    lines = [x for t in OFFICIAL.values() for x in wrapped(t, 60, "").split("\n")] + ["", " ", "é À Kelvin \u212a", "a. b; c: d! e?", "\t\x0b", "All rights reserved."]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(40)))) for i in range(200)] + [(None, "All rights reserved."), (None, None), (7, "")]
    assert both(spark, rows)
