import random

import duckdb
import pytest

from quillon.llm import licenses, line_dedup, link_graph

SPACE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows, least_docs, least_chars, keep_first):
    docs = {(i, t) for i, t in rows}
    where = {}
    for i, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            where.setdefault(low(line.strip(SPACE)), []).append((i, t, pos))
    out = []
    for i, t in rows:
        lines, left = (t or "").split("\n"), []
        for pos, line in enumerate(lines):
            key = low(line.strip(SPACE))
            at = where[key]
            gone = len(key) >= least_chars and len({x[0] for x in at}) >= least_docs
            if gone and keep_first:
                gone = (i, pos) != min((x[0], x[2]) for x in at)
            if not gone:
                left.append(line)
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines(spark, keep_first):
    rng = random.Random(3)
    pool = ["", " ", "Same", "same ", "SAME\x0b", "é", "É", "other", "\t", "x y", "x  y"] + [f"line {i}" for i in range(90)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 200])))) for i in range(40)]
    rows += [(100, None), (101, ""), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keep int")
    for least_docs, least_chars in ((3, 1), (2, 5)):
        got = line_dedup.dropped(df, least_docs, least_chars, keep_first)
        assert got.columns == ["doc_id", "text", "keep", "quillon_lines", "quillon_dropped"]
        rowed = sorted(((r.doc_id, r.quillon_lines, r.quillon_dropped, r.text or "") for r in got.collect()), key=repr)
        assert rowed == brute_lines(rows, least_docs, least_chars, keep_first)


def test_lines_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a\nb"), (1, "a"), (None, "a\nb"), (2, "c")], "doc_id long, text string")
    got = line_dedup.dropped(df, 2, 1)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(None, "b"), (1, ""), (None, "b"), (2, "c")], key=repr)
    assert line_dedup.digests(df.limit(0)).collect() == []


def test_one_id_with_several_texts_is_one_document(spark):
    rows = [(1, "same\na"), (1, "same\nb"), (1, "same\na"), (2, "x\nsame"), (2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dropped(df, 3, 1).collect()) == sorted(t for _, t in rows)
    assert sorted(r.text for r in line_dedup.dropped(df, 2, 1).collect()) == ["a", "a", "b", "x", "y"]


def test_lines_of_long_texts_and_clashing_names(spark):
    rng = random.Random(7)
    common = [f"common {i}" for i in range(20)]
    rows = [(i, "\n".join([rng.choice(common) if rng.random() < 0.01 else f"own {i} {j}" for j in range(20_000)]) + "\n" + "z" * 300_000) for i in range(3)]
    rows += [(9, "z" * 300_000), (10, "common 1"), (11, "common 1\n" * 700), (12, "a")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, quillon_keep string, quillon_dropped int, id int, th int")
    got = line_dedup.dropped(df, 2, 1)
    assert got.columns == ["doc_id", "text", "id", "th", "quillon_lines", "quillon_dropped"]
    rowed = sorted(((r.doc_id, r.quillon_lines, r.quillon_dropped, r.text) for r in got.collect()), key=repr)
    assert rowed == brute_lines(rows, 2, 1, False)


def test_bitmaps_hold_only_words_that_lose_a_line(spark):
    text = "\n".join(f"line {i}" if i not in (70, 71, 9_000) else "gone" for i in range(10_000))
    got = line_dedup.keep_bitmaps(spark.createDataFrame([(1, text), (2, "gone"), (3, "kept")], "doc_id long, text string"), 2).collect()
    assert {r.id: (r.n_dropped, [tuple(e) for e in r.keep]) for r in got} == {1: (3, [(1, ~(3 << 6)), (140, ~(1 << 40))]), 2: (1, [(0, ~1)])}


def test_lines_agree_with_sql(spark):
    rng = random.Random(11)
    pool = ["", " ", "Same", "same ", "\u00e9", "\t", "x y"] + [f"line {i}" for i in range(60)]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))])) for _ in range(120)]
    df = spark.createDataFrame(rows + rows[:10], "doc_id long, text string")
    con = duckdb.connect()
    con.register("arrow_documents", df.toArrow())
    con.sql("CREATE VIEW documents AS SELECT * FROM arrow_documents")
    assert sorted(map(tuple, line_dedup.digests(df).collect()), key=repr) == sorted(con.sql(line_dedup.SQL).fetchall(), key=repr)


def test_url_rules(spark):
    urls = [None, "no scheme", "HTTP://A.Example.NET/en/x?y", "x://example.net/de/", "x://net", "x://notnet/", "x://a.net/?q", "x://b.example.com/de/", "x://b.example.com/d", "x://w.org/fr/1#f", "a://b://c.net/d"]
    df = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_graph.judged(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3][2:] == ("net/", "block")
    assert got[4][:3] == ("net", "", None)
    assert got[5][2:] == (None, "allow")
    assert got[6][2:] == ("net/", "block")
    assert got[7][2:] == ("example.com/de/", "block")
    assert got[9][2:] == ("org/fr/", "allow")
    assert got[10][0] == "b:"
    assert link_graph.judged(df.limit(0)).collect() == []


def sql_agrees(df, **options):
    con = duckdb.connect()
    con.register("arrow_pages", df.toArrow())
    con.sql("CREATE VIEW pages AS SELECT * FROM arrow_pages")
    got = sorted(map(tuple, link_graph.judged(df, **options).collect()), key=repr)
    assert got == sorted(con.sql(link_graph.sql(**options)).fetchall(), key=repr)
    return got


def test_link_scores(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.net" if i < 4 else f"h{i}.org" if i < 8 else f"h{i}.info" for i in range(16)]
    pages = []
    for i in range(120):
        links = "".join(f'<a HREF="http://{rng.choice(hosts)}/p">' for _ in range(rng.randrange(4))) + '<a href="/local"><a href=//H9.info/x>'
        pages.append((i, f"https://{rng.choice(hosts)}{rng.choice(['/fr/a', '/b'])}", links))
    pages += pages[:5] + [(None, "http://h9.info/", "<a href='http://h0.net/'>"), (200, "http://h10.info/x", "<p>" * 200_000 + "<a href='http://h0.net/'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sql_agrees(df, least_distrust=0.2)
    assert len(got) == len(pages) and len({r[4] for r in got if r[3] is None}) == 2


def test_scores_by_plain_sums(spark):
    """Both fixed points, computed host by host."""
    rng = random.Random(5)
    names = [f"h{i}" for i in range(30)]
    trust, distrust = ({h: round(rng.random(), 2) for h in rng.sample(names, 8)} for _ in range(2))
    links = {(a, b): rng.randrange(1, 5) for a in names for b in rng.sample(names, 4) if a != b}
    links |= {("h0", b): 1 for b in names[1:]} | {(a, "h1"): 2 for a in names if a != "h1"}
    seeds = spark.createDataFrame([(h, trust.get(h, 0.0), distrust.get(h, 0.0)) for h in names], "host string, trust double, distrust double")
    edges = spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long")
    out = {a: sum(n for (x, _), n in links.items() if x == a) for a in names}
    good, bad = {h: 0.15 * s for h, s in trust.items()}, dict(distrust)
    for _ in range(12):
        good = {h: 0.15 * trust.get(h, 0) + 0.85 * sum(good.get(a, 0) * n / out[a] for (a, b), n in links.items() if b == h) for h in names}
        bad = {h: distrust.get(h, 0) + 0.85 * (1 - distrust.get(h, 0)) * sum(bad.get(b, 0) * n / out[a] for (a, b), n in links.items() if a == h) for h in names}
    for frame, want in zip(link_graph.scores(seeds, edges, 12, 0.85), (good, bad), strict=True):
        got = {r.host: r.score for r in frame.collect()}
        assert all(abs(got.get(h, 0.0) - x) < 1e-12 for h, x in want.items())


@pytest.mark.parametrize("linkers", [1, 2, 40])
def test_verdict_hangs_on_the_hosts_own_links(spark, linkers):
    """Hosts that link to a blocked host only are blocked however many there are,
    and one that a hub of trust links to, or with few bad links, is not."""
    pages = [(0, "http://bad.net/", "")]
    pages += [(1 + i, f"http://farm{i}.info/", "<a href='http://bad.net/x'>") for i in range(linkers)]
    pages += [(900, "http://far.info/", "<a href='http://farm0.info/'>"), (901, "http://mixed.info/", "<a href='http://bad.net/'>" + "".join(f"<a href='http://ok{i}.info/'>" for i in range(3)))]
    pages += [(910 + i, f"http://t{i}.org/fr/", "<a href='http://seen.info/'>") for i in range(3)] + [(920, "http://seen.info/", "<a href='http://bad.net/'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    verdict = {r[1]: r[4] for r in sql_agrees(df)}
    assert {h for h, v in verdict.items() if v == "block"} == {"bad.net", "far.info", *(f"farm{i}.info" for i in range(linkers))}


def test_licenses(spark):
    rows = [
        (1, "Intro.\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. Words between. You may obtain a copy of the License at\nhttp://x\nSee the License for the specific language governing permissions and limitations under the License."),
        (2, "RELEASED under the MIT  License!"),
        (3, "the mit license"),
        (4, None),
        (5, ""),
        (None, "All rights reserved."),
        (None, "All rights reserved."),
        (6, "word " * 50000 + ". Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, licenses int")
    got = sorted(map(tuple, licenses.scan(df).collect()), key=repr)
    assert got == sorted(
        [
            (1, 4, "apache-licensed,apache-compliance,apache-copy,apache-see", 1, "Apache-2.0,Apache-2.0-header"),
            (2, 1, "mit-released", 0, "MIT"),
            (6, 1, "mit-released", 1, "MIT"),
            (None, 1, "all-rights-reserved", 0, "Proprietary"),
            (None, 1, "all-rights-reserved", 0, "Proprietary"),
        ],
        key=repr,
    )
    assert licenses.scan(df.limit(0)).collect() == []


WRAPPED = {
    "Apache-2.0,Apache-2.0-header": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at

#     http://www.apache.org/licenses/LICENSE-2.0

# See the License for the specific language governing permissions and
# limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_licenses(spark, end):
    texts = [f"Title\n\n\n{t}\n\nMore text.".replace("\n", end) for t in WRAPPED.values()]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.licenses for r in sorted(got)] == list(WRAPPED)
    assert {r.first_sentence for r in got} == {3}
    marks = spark.createDataFrame([(1, "x. |\nAll rights reserved.")], "doc_id long, text string")
    assert licenses.scan(marks).first().first_sentence == 2


def test_no_python_in_the_plans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (licenses.scan(docs), line_dedup.digests(docs)):
        assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


