"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into pieces at line ends and after ".", "!" or "?" followed by white space. Pieces are
normalised (lower case; all that is neither letter nor digit is one space). A known licence sentence
is found where it begins with a piece and ends with the same or a later one, so sentences that are
wrapped, with or without comment signs, or hold an abbreviation are found too; a comment sign
made of letters is a word and breaks a wrapped sentence. The identifiers found in a text are matched
against rules, which are ordered sequences of identifiers: a rule matches where each next identifier
is that of a sentence found first after the end of the last. Of rules that begin at the same place
only the longest is reported, so a complete licence text is not also reported as its first sentence.

Sentences of both tables are few and their number is fixed by this file (or by what the caller
passes, which is checked against ``MAX_SENTENCES`` and ``MAX_RULES``), so both are broadcast. A text
is cut only if it contains one of the marker words, of which every known sentence has one; that
test is exact. No step moves texts between tasks, only the few identifiers found.

A null or empty text has no licence. Repeated rows each get their matches. Null ids are kept. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .linededup import _let

MAX_SENTENCES, MAX_RULES = 5000, 2000

#: Known sentences: identifier and wording.
SENTENCES = (
    ("apache-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-grant", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-grant-full", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-use", "You may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-short", "Released under the MIT License."),
    ("mit-short-2", "This project is licensed under the MIT License."),
    ("mit-title", "MIT License"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl3-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-program", "This program is licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("by-nc-short", "Licensed under CC BY-NC 4.0."),
    ("by-short", "Licensed under CC BY 4.0."),
    ("by-sa-short", "Licensed under CC BY-SA 4.0."),
    ("by-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("by-sa-long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright to the public domain."),
    ("bsd-title-3", "BSD 3-Clause License"),
    ("bsd-title-2", "BSD 2-Clause License"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights", "All rights reserved."),
    ("apache-warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-limits", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache-contributors", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("by-nc-sa-short", "Licensed under CC BY-NC-SA 4.0."),
    ("by-nc-nd-short", "Licensed under CC BY-NC-ND 4.0."),
    ("by-nd-short", "Licensed under CC BY-ND 4.0."),
    ("by-nc-long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("by-nc-sa-long", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("by-nc-nd-long", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("by-nd-long", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("by3-long", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("by-sa3-long", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("cc0-short", "Licensed under CC0 1.0."),
)

#: Licences that a line "SPDX-License-Identifier: ..." may name.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 OFL-1.1 PostgreSQL Python-2.0 Unlicense WTFPL Zlib"
).split()
SENTENCES += tuple((f"spdx-{x.lower()}", f"SPDX-License-Identifier: {x}") for x in SPDX)

#: Rules: licence, and the identifiers that stand one after the other.
RULES = (
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-grant-full",)),
    ("Apache-2.0", ("apache-grant-full", "apache-copy")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("MIT", ("mit-title", "mit-notice")),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0", ("gpl3-program",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("CC-BY-NC-4.0", ("by-nc-short",)),
    ("CC-BY-4.0", ("by-short",)),
    ("CC-BY-4.0", ("by-long",)),
    ("CC-BY-SA-4.0", ("by-sa-short",)),
    ("CC-BY-SA-4.0", ("by-sa-long",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-3-Clause", ("bsd-title-3", "bsd-redistribution")),
    ("BSD-2-Clause", ("bsd-title-2", "bsd-redistribution")),
    ("BSD", ("bsd-redistribution",)),
    ("MPL-2.0", ("mpl",)),
    ("MPL-2.0", ("mpl", "mpl-copy")),
    ("ISC", ("isc",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("all-rights",)),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-warranty", "apache-limits")),
    ("Apache-2.0", ("apache-grant-full", "apache-copy", "apache-warranty")),
    ("Apache-2.0", ("apache-grant-full", "apache-copy", "apache-warranty", "apache-limits")),
    ("Apache-2.0", ("apache-contributors",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT-0", ("mit-grant", "mit-warranty")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-title-3", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty", "gpl-details", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty", "gpl-details", "gpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("EPL-2.0", ("epl2",)),
    ("BSL-1.0", ("boost",)),
    ("Zlib", ("zlib", "zlib-grant")),
    ("OFL-1.1", ("ofl",)),
    ("CC-BY-NC-SA-4.0", ("by-nc-sa-short",)),
    ("CC-BY-NC-SA-4.0", ("by-nc-sa-long",)),
    ("CC-BY-NC-ND-4.0", ("by-nc-nd-short",)),
    ("CC-BY-NC-ND-4.0", ("by-nc-nd-long",)),
    ("CC-BY-ND-4.0", ("by-nd-short",)),
    ("CC-BY-ND-4.0", ("by-nd-long",)),
    ("CC-BY-NC-4.0", ("by-nc-long",)),
    ("CC-BY-3.0", ("by3-long",)),
    ("CC-BY-SA-3.0", ("by-sa3-long",)),
    ("CC0-1.0", ("cc0-short",)),
) + tuple((x, (f"spdx-{x.lower()}",)) for x in SPDX)

#: Every known sentence has one of these within a word; others may be passed with other sentences.
MARKERS = ("licens", "copyright", "reserved", "warrant", "redistribut", "domain", "mpl", "endorse")

#: A sentence end that is not a line end, and what normalising replaces by one space.
_END, _OTHER = r"([.!?])[ \t\r]+", r"[^\p{L}\p{N}]+"
#: The same within a text whose pieces are lines.
_OTHER_INSIDE = r"[^\p{L}\p{N}\n]+"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), _OTHER, " "))


def _pieces(text: Column) -> Column:
    """(position, norm) of each piece that has a word."""
    cut = F.regexp_replace(F.lower(F.regexp_replace(text, _END, "$1\n")), _OTHER_INSIDE, " ")
    parts = F.transform(F.split(cut, "\n", -1), lambda x, i: F.struct(i.alias("position"), F.trim(x).alias("norm")))
    return F.filter(parts, lambda x: x["norm"] != "")


def _begun(pieces: Column, heads: list[str], most: int) -> Column:
    """(position, head, rest) of each piece that begins with a known first word; rest has ``most`` pieces, as lines."""
    head = lambda x: F.substring_index(x["norm"], " ", 1)
    numbered = F.transform(pieces, lambda x, i: F.struct(x["position"].alias("position"), head(x).alias("head"), i.alias("i")))
    begun = F.filter(numbered, lambda x: x["head"].isin(heads))
    rest = lambda x: F.array_join(F.transform(F.slice(pieces, x["i"] + 1, F.lit(most)), lambda y: y["norm"]), "\n")
    ends = lambda x: F.transform(F.slice(pieces, x["i"] + 1, F.lit(most)), lambda y: y["position"])
    return F.transform(begun, lambda x: F.struct(x["position"].alias("position"), x["head"].alias("head"), rest(x).alias("rest"), ends(x).alias("ends")))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", known=SENTENCES, rules=RULES, markers=MARKERS) -> DataFrame:
    """(key, license, position, matched): each rule match; position counts sentences from 0.

    ``matched`` holds the identifiers of the rule, joined by blanks.
    """
    if len(known) > MAX_SENTENCES or len(rules) > MAX_RULES:
        raise ValueError("too many sentences or rules to send to every task")
    spark = docs.sparkSession
    lookup = spark.createDataFrame([(i, s) for i, s in known], "sid string, wording string")
    lookup = lookup.select("sid", normalised(F.col("wording")).alias("norm")).groupBy("norm").agg(F.min("sid").alias("sid"))
    lookup = lookup.where("norm <> ''").withColumn("head", F.substring_index("norm", " ", 1))
    listed = lookup.select("head", "norm").collect()
    heads, most = sorted({r["head"] for r in listed}), max((r["norm"].count(" ") + 1 for r in listed), default=1)
    low = F.lower(F.col(text))
    wanted = F.lit(False)
    for m in markers:
        wanted = wanted | low.contains(m)
    row = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("text"), F.length(text).alias("n"))
    begun = _let(_pieces(F.col(text)), lambda pieces: _begun(pieces, heads, most))
    parts = docs.where(wanted).select(row.alias("doc"), F.explode(begun).alias("part")).select("doc", "part.*")
    # A sentence is found where it ends with a piece too: there the rest ends or has a line end.
    tried = parts.join(F.broadcast(lookup), "head").where(F.translate("rest", "\n", " ").startswith(F.col("norm")))
    after = F.substring(F.col("rest"), F.length("norm") + 1, F.lit(1))
    within = F.substring(F.col("rest"), F.lit(1), F.length("norm"))
    end = F.element_at("ends", F.length("within") - F.length(F.translate("within", "\n", "")) + 1)
    found = tried.where((after == "") | (after == "\n")).withColumn("within", within).select("doc", "position", "sid", end.alias("end"))
    # Rows repeated with the same id and text fall together here, and are counted.
    listed = found.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("position", "sid", "end"))).alias("ids"), F.count("*").alias("all"))
    started = listed.select("doc", "ids", F.expr("cast(all / size(ids) as int)").alias("copies"), F.explode("ids").alias("head"))
    table_ = spark.createDataFrame([(lic, list(seq), seq[0]) for lic, seq in rules], "license string, seq array<string>, sid string")
    tried = started.join(F.broadcast(table_), F.col("head.sid") == F.col("sid"))

    def step(end: Column, sid: Column) -> Column:
        """The end of the next sentence found, if it is ``sid``; else null."""
        later = F.filter("ids", lambda x: x["position"] > end)
        fit = F.filter(later, lambda x: (x["position"] == F.get(later, F.lit(0))["position"]) & (x["sid"] == sid))
        return F.get(fit, F.lit(0))["end"]

    through = F.aggregate(F.slice("seq", 2, F.size("seq")), F.col("head.end"), step)
    order = F.struct(F.size("seq"), F.col("license"), F.array_join("seq", " "))
    best = tried.where(through.isNotNull()).groupBy("doc", F.col("head.position").alias("at")).agg(F.max_by(F.struct("license", "seq", "head", "copies"), order).alias("m"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m.copies"))))
    return best.select(F.col("doc.id").alias(key), F.col("m.license").alias("license"), F.col("m.head.position").alias("position"), F.array_join("m.seq", " ").alias("matched"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _values(rows) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) if isinstance(x, str) else "[" + ", ".join(map(quote, x)) + "]" for x in row) + ")" for row in rows)


_SQL_NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
#: Pieces begin at line ends and after the end of a sentence; a sentence is one piece or several in a row.
OP10_SQL = f"""
WITH RECURSIVE k AS (
  SELECT {_SQL_NORM.format("wording")} AS norm, min(sid) AS sid FROM (VALUES {_values(SENTENCES)}) AS v(sid, wording) GROUP BY 1
), r AS (
  SELECT license, seq, len(seq) AS n FROM (VALUES {_values(RULES)}) AS v(license, seq)
), s AS (
  SELECT doc_id, {_SQL_NORM.format("unnest(parts)")} AS norm, generate_subscripts(parts, 1) - 1 AS position
  FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents)
), d AS (
  SELECT doc_id, list(norm ORDER BY position) AS norms, list(position ORDER BY position) AS places FROM s WHERE norm <> '' GROUP BY doc_id
), b AS (
  SELECT doc_id, norms, places, unnest(range(1, len(norms) + 1)) AS i FROM d
), f AS (
  SELECT doc_id, places[i] AS position, places[j] AS finish, sid FROM (
    SELECT b.doc_id, b.norms, b.places, b.i, k.norm, k.sid, unnest(range(b.i, least(b.i + len(string_split(k.norm, ' ')), len(b.norms) + 1))) AS j
    FROM b JOIN k ON starts_with(k.norm, b.norms[b.i])
  ) WHERE array_to_string(norms[i:j], ' ') = norm
), nx AS (
  SELECT e.doc_id, e.finish, min(g.position) AS position FROM (SELECT DISTINCT doc_id, finish FROM f) e JOIN f g ON g.doc_id = e.doc_id AND g.position > e.finish GROUP BY 1, 2
), m AS (
  SELECT f.doc_id, f.position, f.finish, r.license, r.seq, r.n, 1 AS step FROM f JOIN r ON r.seq[1] = f.sid
  UNION ALL
  SELECT m.doc_id, m.position, g.finish, m.license, m.seq, m.n, m.step + 1 FROM m
  JOIN nx ON nx.doc_id = m.doc_id AND nx.finish = m.finish JOIN f g ON g.doc_id = m.doc_id AND g.position = nx.position AND g.sid = m.seq[m.step + 1] WHERE m.step < m.n
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY n DESC, license DESC, array_to_string(seq, ' ') DESC) AS best FROM m WHERE step = n
)
SELECT doc_id, license, position::INTEGER AS position, array_to_string(seq, ' ') AS matched FROM w WHERE best = 1
"""
