import math
import os
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import license_texts, licenses, queries

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "text without"), (3, "a/b/c/y.txt", "Licensed under CC BY-NC 4.0.\nmore"), (4, "a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
    (5, "a/z.txt", None), (6, "other/q.txt", ""), (7, None, "nothing"), (None, "a/b/d/e/f.txt", "plain"), (8, "top.txt", "a licence of some unknown kind"), (2, "a/b/x.txt", "text without"),
]


def test_inheritance(spark):
    files = spark.createDataFrame(FILES, "doc_id long, path string, text string").withColumns({c: F.lit("x") for c in ("row", "license", "line", "dir", "token", "kind", "units")})
    got = sorted([(r.doc_id, r.path, r.license, r.basis, r.origin) for r in licenses.scan(files, licenses.template_table(spark)).collect()], key=str)
    assert got == sorted([
        (1, "a/LICENSE", "MIT", "own", "a/LICENSE"), (2, "a/b/x.txt", "Apache-2.0", "inherited", "a/b"), (2, "a/b/x.txt", "Apache-2.0", "inherited", "a/b"), (3, "a/b/c/y.txt", "CC-BY-NC-4.0", "own", "a/b/c/y.txt"),
        (4, "a/b/LICENSE.md", "Apache-2.0", "own", "a/b/LICENSE.md"), (5, "a/z.txt", "MIT", "inherited", "a"), (6, "other/q.txt", None, "none", None), (7, "", None, "none", None),
        (None, "a/b/d/e/f.txt", "Apache-2.0", "inherited", "a/b"), (8, "top.txt", None, "none", None),
    ], key=str)
    assert licenses.scan(files.limit(0), licenses.template_table(spark)).collect() == []


def toks(text):
    return re.findall(r"[a-z0-9]+(?:[.-][0-9]+)*", text.lower())


def slow(texts, some=None, templates=licenses.TEMPLATES, least=0.8, rare=0.01):
    """{position: (licence, score, kind, line, last)} from all pairs of units and templates, for the
    texts at the positions `some` (all by default); frequencies are those of all texts."""
    df = Counter(t for x in texts for t in set(toks(x or "")))
    idf = lambda t: math.log1p(1 / max(rare, df[t] / len(texts)))

    def vector(ts):
        w = {t: (1 + math.log(n)) * idf(t) for t, n in Counter(ts).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    known = [(k, vector(toks(n))) for k, n in templates]
    out = {}
    for at in range(len(texts)) if some is None else some:
        text, found = re.sub(r"\s+$", "", texts[at] or ""), []
        cuts = (re.split(r"[.!?;]\s+|\n", text), re.split(r"\n[^\w\n]*\n", text), [text])
        for kind, parts in enumerate(cuts):
            for line, unit in enumerate(parts):
                if not toks(unit):
                    continue
                v = vector(toks(unit))
                for k, t in known:
                    score = round(sum(x * t.get(w, 0) for w, x in v.items()), 6)
                    if score >= least - 1e-9:
                        found.append((-score, kind, line, k, line == len(parts) - 1))
        if found:
            least_score = min(found)
            out[at] = (least_score[3], -least_score[0], *least_score[1:3], least_score[4])
    return out


def commented(text, mark="# ", width=70):
    lines, now = [], ""
    for w in text.split():
        if len(now) + len(w) > width:
            lines.append(now)
            now = ""
        now += " " * bool(now) + w
    return "\n".join(mark + x for x in (*lines, now))


GPL3 = license_texts.FREE.format("program", "GNU General Public License", "3")
WARRANTY = license_texts.WARRANTY.format("GNU General Public License")
MIT = "\n\n".join(("MIT License", "Copyright (c) 2020 Jane Roe", *(commented(x, "") for x in (license_texts.GRANT, license_texts.NOTICE, license_texts.AS_IS))))
BSD3 = "\n\n".join(("Copyright (c) 2020, Jane Roe. All rights reserved.", *(commented(x, "") for x in (license_texts.BSD_GRANT, license_texts.BSD_SOURCE, license_texts.BSD_BINARY, license_texts.BSD_NAMES, license_texts.BSD_END))))
REAL = [
    ("MIT", MIT), ("MIT", "# SPDX-License-Identifier: MIT\nimport os\n"), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0", "/* SPDX-License-Identifier: GPL-3.0-or-later */\nint x;"),
    ("GPL-3.0", commented(GPL3) + "\n#\n" + commented(WARRANTY) + "\n\nx = 1\n"), ("Apache-2.0", "/*\n" + commented(license_texts.APACHE_USE, " * ") + "\n *\n" + commented(license_texts.APACHE_END, " * ") + "\n */\nint main;"),
    ("BSD-3-Clause", BSD3), ("BSD-2-Clause", BSD3.replace("\n\n" + commented(license_texts.BSD_NAMES, ""), "")), ("MIT", "Some readme text.\n\nThis project is licensed under the MIT License.\n"), ("MPL-2.0", commented(license_texts.MPL)),
    ("ISC", commented(license_texts.ISC_GRANT, "") + "\n\n" + commented(license_texts.ISC_END, "")), ("LGPL-2.1", commented(license_texts.FREE.format("library", "GNU Lesser General Public License", "2.1"), " * ")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n\n Copyright"), ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
    ("Unlicense", license_texts.UNLICENSE + "\n\n" + license_texts.UNLICENSE_USE), ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    (None, "the licence plate of the car was under the seat"), (None, "All rights reserved."), (None, "we use this software and may copy the project"), (None, ""), (None, None),
]


def test_real_notices_headers_and_files(spark):
    """SPDX tags, wrapped and commented headers, whole licence files; all scores as by all pairs."""
    prose = [f"plain text number {k} of the table and its own words w{k} under the sun with no terms" for k in range(300)]
    files = [*REAL, *[(None, x) for x in prose]]
    table = spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, (_, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.score) for r in licenses.scan(table, licenses.template_table(spark)).collect()}
    assert {i: got[i][0] for i in got} == {i: k for i, (k, _) in enumerate(files)}
    want = slow([t for _, t in files])
    assert {i: v[0] for i, v in want.items()} == {i: v[0] for i, v in got.items() if v[0]}
    assert all(abs(got[i][1] - v[1]) < 2e-6 for i, v in want.items())


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="no licence files on this machine")
def test_whole_texts_from_a_folder(spark, tmp_path):
    for name, source in (("GPL-3.0", "GPL-3"), ("Apache-2.0.txt", "Apache-2.0"), ("LGPL-3.0", "LGPL-3")):
        (tmp_path / name).write_text(open(f"/usr/share/common-licenses/{source}").read())
    templates = licenses.read_templates(spark, str(tmp_path))
    texts = {n: open(f"/usr/share/common-licenses/{n}").read() for n in ("GPL-3", "Apache-2.0", "LGPL-3")}
    table = spark.createDataFrame([(i, f"{n}/LICENSE", t) for i, (n, t) in enumerate(texts.items())] + [(9, "Apache-2.0/src/a/x.c", "int x;"), (10, "other/x.c", "int x;")], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.basis) for r in licenses.scan(table, templates).collect()}
    assert got == {"GPL-3/LICENSE": ("GPL-3.0", "own"), "Apache-2.0/LICENSE": ("Apache-2.0", "own"), "LGPL-3/LICENSE": ("LGPL-3.0", "own"), "Apache-2.0/src/a/x.c": ("Apache-2.0", "inherited"), "other/x.c": (None, "none")}
    known = {r.path: r.license for r in licenses.scan(table, licenses.template_table(spark)).collect()}  # by their titles
    assert [known[f"{n}/LICENSE"] for n in texts] == ["GPL-3.0", "Apache-2.0", "LGPL-3.0"]


def test_query_against_all_pairs(spark):
    """The registered query against scores of all units and templates, and inheritance by hand."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    near = lambda r: re.search("(?i)licen|releas|copyright|spdx|gpl|permission|domain|clause|software", r.text or "")
    want = slow([r.text for r in docs], [i for i, r in enumerate(docs) if near(r) or r.doc_id % 50 == 0])
    got = {r.doc_id: r for r in queries.op7_licenses(spark, sf).collect()}
    assert set(got) == {r.doc_id for r in docs} and len(want) > 30
    given = {}
    for i, r in enumerate(docs):
        own = want.get(i)
        assert (got[r.doc_id].basis == "own") == bool(own)
        if own:
            assert got[r.doc_id].license == own[0] and abs(got[r.doc_id].score - own[1]) < 2e-6
            if own[2] == 0 and (own[3] == 0 or own[4]):
                given.setdefault((r.source, r.lang, r.doc_id // 1000), []).append((-got[r.doc_id].score, r.doc_id, own[0]))
    inherited = 0
    for i, r in enumerate(docs):
        if i not in want:
            known = given.get((r.source, r.lang, r.doc_id // 1000))
            inherited += bool(known)
            assert got[r.doc_id].basis == ("inherited" if known else "none")
            assert got[r.doc_id].license == (min(known)[2] if known else None)
    assert inherited > 50


def test_very_long_text(spark):
    """Work follows the text's length: one text of 400,000 words, one of a single huge line."""
    long = "\n".join(f"license word{k} software {k % 977} under terms." for k in range(80_000))
    table = spark.createDataFrame([(1, "a/x", long), (2, "a/y", long.replace("\n", " ").replace(". ", " ")), (3, "a/z", "Licensed under the MIT License")], "doc_id long, path string, text string")
    began = time.time()
    got = {r.doc_id: r.license for r in licenses.scan(table, licenses.template_table(spark)).collect()}
    assert got == {1: None, 2: None, 3: "MIT"} and time.time() - began < 60


def test_ties_and_sizes(spark):
    """Equal scores go to the earlier unit and the name; weights do not drift with the table's size."""
    templates = spark.createDataFrame([("B", "alpha beta gamma"), ("A", "gamma beta alpha"), ("C", "delta epsilon")], "license string, notice string")
    rows = [("delta epsilon\nalpha beta gamma",), ("alpha beta gamma\ndelta epsilon",), ("alpha beta gamma\nalpha beta gamma",), ("a project with alpha beta gamma",)] + [("plain words of no licence",)] * 100
    seen = []
    for times in (1, 8):
        table = spark.createDataFrame([(i, f"d{i}/f", t) for i, (t,) in enumerate(rows * times)], "doc_id long, path string, text string")
        got = {r.doc_id: (r.license, r.score) for r in licenses.scan(table, templates, least=0.5).collect()}
        assert [got[i][0] for i in range(3)] == ["C", "A", "A"]
        assert all(got[i] == got[i % len(rows)] for i in got)
        seen.append(got[3])
    assert seen[0] == seen[1] and seen[0][0] == "A"


def test_main_path_has_no_python(spark, sf):
    plan = queries.op7_licenses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
