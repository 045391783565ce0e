"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

DataFrame functions only. Possible notices of a file are its lines and its blocks (two or more consecutive lines that
are not blank, so that a wrapped notice or a paragraph is one unit); of a licence file (by its name, or flagged) the
whole text is one too. Templates are short notices and whole licence texts. Vectors are term counts times idf, with
document frequencies of all terms over all files. A directory declares the licence of its licence files, or else the
one that more than half of the licensed files below it name; a file without a notice takes the licence of its nearest
ancestor directory that declares one.

Candidate units are found by a prefix filter that loses nothing: a unit can only reach the threshold with a
template if it holds one of the template's heaviest terms, as the others together have too little weight.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragbench.llm.common import SPACE, stored

#: Licence names and texts of notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/."""),
)
THRESHOLD = 0.8
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.-][a-z0-9_.-]+)?$"
#: Between blocks: a line without words, or several.
_GAP = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
_TERMS = "[^a-z0-9]+"


def _terms(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


VOCABULARY = sorted({t for _, text in TEMPLATES for t in _terms(text)})


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case (A-Z only)."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _TERMS, -1), lambda t: t != "")


def frequencies(files: DataFrame) -> tuple[DataFrame, int]:
    """(term, idf) of every term, with document frequencies over all files that have a text, and the number of these."""
    texts = files.where("text is not null")
    counts = stored(texts.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df")
    n = texts.count()
    return counts.select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf")), n


def of_templates(frequencies: DataFrame, n: int) -> dict[str, float]:
    """idf of the templates' terms, a fixed list."""
    found = {r[0]: r[1] for r in frequencies.where(F.col("term").isin(VOCABULARY)).collect()}
    return {t: found.get(t, math.log(n + 1) + 1) for t in VOCABULARY}


def anchors(idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a text needs at least one to reach the threshold with any template."""
    out: set[str] = set()
    for _, text in TEMPLATES:
        weights = sorted(((n * idf[t]) ** 2, t) for t, n in Counter(_terms(text)).items())
        total, rest = sum(w for w, _ in weights), 0.0
        for w, t in weights:
            rest += w
            if rest >= (threshold - 1e-9) ** 2 * total:
                out.add(t)
    return sorted(out)


def units_of(files: DataFrame) -> DataFrame:
    """(path, unit, terms): the lines (l0, l1, ...), blocks (b0, ...) and, of licence files, whole texts (f0)."""
    def numbered(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, k: F.struct(F.concat(F.lit(kind), k.cast("string")).alias("unit"), x.alias("text")))

    lines = numbered("l", F.split("text", "\n", -1))
    blocks = F.filter(numbered("b", F.split("text", _GAP, -1)), lambda x: F.contains(F.btrim(x["text"], F.lit(SPACE)), F.lit("\n")))
    whole = F.when(F.col("licence_file"), numbered("f", F.array("text"))).otherwise(F.array().cast("array<struct<unit:string,text:string>>"))
    units = files.where("text is not null").select("path", F.explode(F.concat(lines, blocks, whole)).alias("u"))
    return units.select("path", "u.unit", tokens(F.col("u.text")).alias("terms"))


def notices(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, unit, licence, score): for each notice the template with the greatest cosine, if it reaches the threshold.

    ``files`` has path, text and licence_file.
    """
    spark = files.sparkSession
    weights, n = frequencies(files)
    idf = of_templates(weights, n)
    possible = units_of(files).where(F.arrays_overlap("terms", F.array(*map(F.lit, anchors(idf, threshold)))))
    terms = stored(possible.select("path", "unit", F.explode("terms").alias("term")).groupBy("path", "unit", "term").agg(F.count("*").alias("n")), "terms")
    vectors = terms.join(weights.hint("merge"), "term").select("path", "unit", "term", (F.col("n") * F.col("idf")).alias("w"))
    rows = []
    for no, (licence, text) in enumerate(TEMPLATES):
        counts = Counter(_terms(text))
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        rows += [(no, licence, t, n * idf[t] / norm) for t, n in counts.items()]
    templates = F.broadcast(spark.createDataFrame(rows, "template int, licence string, term string, tw double"))  # a fixed list
    norms = vectors.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("path", "unit"))))
    scored = norms.join(templates, "term").groupBy("path", "unit", "template", "licence").agg(F.round(F.sum(F.col("w") * F.col("tw") / F.col("norm")), 9).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("path", "unit").agg(F.max(F.struct("score", F.col("licence"))).alias("b"))
    return best.select("path", "unit", "b.licence", F.col("b.score").alias("score"))


def ancestors(path: Column) -> Column:
    """(directory, depth) for each directory above a path; the root is the empty string at depth 0."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("dir"), k.cast("int").alias("depth")))


def scan_licences(files: DataFrame, path: str = "path", text: str = "text", flag: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(path, n_notices, own, licence, origin, source_dir, score) for every file.

    ``n_notices`` are the units (lines, blocks, whole text) with a notice. ``origin`` is ``header`` (a notice of its own;
    the greatest score, then the greatest name, wins), ``inherited`` or ``none``. Null and empty texts have no notice;
    rows with a null path have no directory and inherit nothing; rows that share a path are one file, with the units of
    all of them. Texts are read whole, whatever their length; a unit is as long as its block. Other columns are
    dropped, so no name can clash. An empty table gives an empty table.
    """
    is_file = F.coalesce(F.col(flag), F.lit(False)) if flag else F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False))
    base = files.select(F.col(path).alias("path"), F.col(text).alias("text"), is_file.alias("licence_file"))
    found = stored(notices(base, threshold), "notices")
    own = found.groupBy("path").agg(F.count("*").alias("n_notices"), F.max(F.struct("score", "licence")).alias("b"), F.array_sort(F.collect_set("licence")).alias("names"))
    listed = base.select("path", "licence_file").groupBy("path").agg(F.max("licence_file").alias("licence_file"))
    all_files = stored(listed.join(own.hint("merge"), listed["path"].eqNullSafe(own["path"]), "left").select(listed["path"], "licence_file", "n_notices", "b.licence", "b.score", "names"), "files")
    licensed = all_files.where("licence is not null and path is not null")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    # Licence files speak for their own directory; without one, the majority of the licensed files below decides.
    direct = licensed.where("licence_file").select(parent.alias("dir"), "licence", "score").groupBy("dir").agg(F.max(F.struct("score", "licence"))["licence"].alias("named"))
    below = licensed.where("not licence_file").select(F.explode(ancestors(F.col("path"))).alias("a"), "licence").groupBy("a.dir", "licence").count()
    tally = below.groupBy("dir").agg(F.max(F.struct("count", "licence")).alias("top"), F.sum("count").alias("n")).where("2 * top.count > n").select("dir", F.col("top.licence").alias("most"))
    declared = stored(direct.join(tally.hint("merge"), "dir", "full").select("dir", F.coalesce("named", "most").alias("inherited")), "declared")
    folders = all_files.where("path is not null").select(parent.alias("folder")).distinct()
    above = folders.select("folder", F.explode(ancestors(F.concat("folder", F.lit("/x")))).alias("a"))
    above = above.where((F.col("a.depth") > 0) | (F.col("folder") == ""))
    nearest = above.select("folder", F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth")).join(declared.hint("merge"), "dir")
    nearest = stored(nearest.groupBy("folder").agg(F.max(F.struct("depth", "dir", "inherited")).alias("n")).select("folder", "n.dir", "n.inherited"), "nearest")
    rows = all_files.withColumn("folder", F.when(F.col("path").isNotNull(), parent)).join(nearest.hint("merge"), "folder", "left")
    origin = F.when(F.col("licence").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return rows.select(
        "path", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.array_join(F.coalesce("names", F.array().cast("array<string>")), ",").alias("own"),
        F.coalesce("licence", "inherited").alias("licence"), origin.alias("origin"),
        F.when(origin == "inherited", F.col("dir")).alias("source_dir"), F.round("score", 6).alias("score"),
    )


#: In the query, documents whose first line speaks of a licence are licence files of their folder.
_FIRST_LINE = r"^[^\n]*[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]"


def op8_licence_scan(docs: DataFrame) -> DataFrame:
    """The query: documents as files at source/lang/doc_id (licence files: source/lang/LICENSE-doc_id; a null part is _)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    name = F.when(F.coalesce(F.col("text").rlike(_FIRST_LINE), F.lit(False)), F.concat(F.lit("LICENSE-"), part("doc_id"))).otherwise(part("doc_id"))
    return scan_licences(docs.select(F.concat_ws("/", part("source"), part("lang"), name).alias("path"), "text"))


def oracle() -> str:
    """DuckDB SQL for the query, from the same templates and formulas; every unit meets every template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({no}, '{licence}', {quoted(text)})" for no, (licence, text) in enumerate(TEMPLATES))
    split = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda t: t <> '')"
    return f"""
WITH f0 AS (SELECT coalesce(source, '_') AS d1, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_')) AS d2, coalesce(doc_id::VARCHAR, '_') AS name, text, coalesce(regexp_matches(text, '{_FIRST_LINE}'), false) AS lic FROM documents),
f AS (SELECT d2 || '/' || CASE WHEN lic THEN 'LICENSE-' ELSE '' END || name AS path, d1, d2, lic, text FROM f0),
t AS (SELECT no, licence, unnest({split.format('txt')}) AS term FROM (VALUES {values}) v(no, licence, txt)),
tc AS (SELECT no, licence, term, count(*) AS n FROM t GROUP BY ALL),
dt AS (SELECT path, unnest(list_distinct({split.format('text')})) AS term FROM f WHERE text IS NOT NULL),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
nn AS (SELECT count(*) AS n FROM f WHERE text IS NOT NULL),
idf AS (SELECT term, ln(((SELECT n FROM nn) + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM tc UNION SELECT term FROM df) LEFT JOIN df USING (term)),
tw AS (SELECT no, licence, term, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY no)) AS tw FROM tc JOIN idf USING (term)),
l AS (SELECT path, 'l' || unnest(range(len(x))) AS unit, unnest(x) AS line FROM (SELECT path, string_split(text, chr(10)) AS x FROM f)
  UNION ALL SELECT path, unit, line FROM (SELECT path, 'b' || unnest(range(len(x))) AS unit, unnest(x) AS line FROM (SELECT path, string_split_regex(text, '{_GAP}') AS x FROM f)) WHERE contains(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10))
  UNION ALL SELECT path, 'f0', text FROM f WHERE lic),
lt AS (SELECT path, unit, unnest({split.format('line')}) AS term FROM l),
lw AS (SELECT path, unit, term, count(*) * any_value(idf) AS w FROM lt JOIN idf USING (term) GROUP BY ALL),
ln_ AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY path, unit)) AS norm FROM lw),
sc AS (SELECT path, unit, no, licence, round(sum(w * tw / norm), 9) AS score FROM ln_ JOIN tw USING (term) GROUP BY ALL),
best AS (SELECT path, unit, max({{'score': score, 'licence': licence}}) AS b FROM sc WHERE score >= {THRESHOLD} GROUP BY ALL),
own AS (SELECT path, count(*) AS n_notices, max(b) AS b, array_to_string(list_sort(list(DISTINCT b.licence)), ',') AS names FROM best GROUP BY path),
lf AS (SELECT f.path, d1, d2, lic, b.score AS score, b.licence AS licence FROM f JOIN own USING (path)),
direct AS (SELECT d2 AS dir, max({{'score': score, 'licence': licence}}).licence AS named FROM lf WHERE lic GROUP BY d2),
below AS (SELECT dir, licence, count(*) AS c FROM (SELECT d2 AS dir, licence FROM lf WHERE NOT lic UNION ALL SELECT d1, licence FROM lf WHERE NOT lic) GROUP BY ALL),
most AS (SELECT dir, arg_max(licence, {{'c': c, 'l': licence}}) AS most FROM below GROUP BY dir HAVING 2 * max(c) > sum(c)),
decl AS (SELECT dir, coalesce(named, most) AS inherited FROM direct FULL JOIN most USING (dir))
SELECT f.path, coalesce(n_notices, 0) AS n_notices, coalesce(names, '') AS own, coalesce(b.licence, a.inherited, z.inherited) AS licence,
  CASE WHEN b IS NOT NULL THEN 'header' WHEN coalesce(a.inherited, z.inherited) IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN b IS NULL THEN CASE WHEN a.inherited IS NOT NULL THEN d2 WHEN z.inherited IS NOT NULL THEN d1 END END AS source_dir, round(b.score, 6) AS score
FROM f LEFT JOIN own USING (path) LEFT JOIN decl a ON a.dir = d2 LEFT JOIN decl z ON z.dir = d1"""
