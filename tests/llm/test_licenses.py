import re
import textwrap

from thoughtloom.llm import licenses


def norm(s):
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def brute(rows):
    known = {}
    for sid, wording in licenses.SENTENCES:
        known[norm(wording)] = min(sid, known.get(norm(wording), sid))
    out = []
    for key, text in rows:
        if text is None:
            continue
        parts = re.sub(r"([.!?])[ \t\r]+", r"\1\n", text).split("\n")
        ids = [(i, known[norm(p)]) for i, p in enumerate(parts) if norm(p) in known]
        for a in range(len(ids)):
            hits = [(len(seq), lic, seq) for lic, seq in licenses.RULES if tuple(s for _, s in ids[a : a + len(seq)]) == seq]
            if hits:
                _, lic, seq = max(hits)
                out.append((key, lic, ids[a][0], " ".join(seq)))
    return sorted(out, key=repr)


def test_every_sentence_has_a_marker():
    for _, wording in licenses.SENTENCES:
        assert any(m in wording.lower() for m in licenses.MARKERS), wording
    ids = {s for s, _ in licenses.SENTENCES}
    assert all(set(seq) <= ids for _, seq in licenses.RULES)


def test_matches_brute_force(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n'
    rows = [(1, apache), (2, "Text. ALL  rights, reserved!\n"), (3, "licensed under cc by-nc 4.0"), (4, None), (5, ""), (6, "a license of my own"), (7, "MIT License\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. All rights reserved."), (8, "MIT License"), (None, "All rights reserved."), (2, "Text. ALL  rights, reserved!\n"), (9, "é. " * 5000 + "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sid", "'x' as license", "3 as position", "'n' as norm")
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=repr)
    assert got == brute(rows)
    assert len(got) == 8


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_rule_in_a_wrapped_header(spark):
    wordings, rows, wanted = dict(licenses.SENTENCES), [], set()
    for k, (lic, seq) in enumerate(licenses.RULES):
        for j, (width, sign) in enumerate([(30, "# "), (60, " * "), (72, ""), (10_000, "// ")]):
            lines = [line for s in seq for line in textwrap.wrap(wordings[s], width, break_long_words=False, break_on_hyphens=False)]
            rows.append((10 * k + j, f"Some text before.\n\n{sign}" + f"\n{sign}".join(lines) + "\n\nAnd after it.\n"))
            wanted.add((10 * k + j, lic))
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.position == 2}
    assert wanted - got == set()


def test_the_apache_header_as_files_have_it(spark):
    text = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in\n# compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n'
    got = [tuple(r) for r in licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert got == [(1, "Apache-2.0", 0, "apache-grant apache-use apache-copy")]


def test_the_sql_says_the_same(spark):
    import duckdb

    wording = dict(licenses.SENTENCES)
    texts = [" ".join(wording[i] for i in seq) for _, seq in licenses.RULES]
    rows = list(enumerate([t.replace(" the ", "\n// the ") for t in texts] + texts + ["MIT License\n\n" + wording["mit-notice"], "none", "", "All rights\nreserved. All rights reserved."]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan_licenses(docs).select("doc_id", "license", "position", "matched").collect())
    documents = docs.toPandas()  # noqa: F841 - read by the SQL
    assert got == sorted(duckdb.sql(licenses.OP10_SQL).fetchall())
