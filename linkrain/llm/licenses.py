"""License scans: units of texts compared to licence templates by Dice's coefficient over word bigrams.

Units are lines, the whole text, and windows of words of a template's size, so that a notice is found where it is
wrapped over lines or stands within a longer one. Texts and templates are normalised alike: all that is no
ASCII letter or digit and no character beyond ASCII is a blank, and letters are lower case. With n bigrams in a
unit and m in a template, counted with repetitions, the coefficient is twice the common ones by n + m, at most
2 min(n, m) / (n + m); templates whose size rules the threshold out are not compared, and of a unit's bigrams
only those of any template are kept. A window begins at a bigram of its template, and a template has windows only
in texts with as many of its bigrams as the least size allows. All of it are column expressions; there is no
shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence notices and short licence texts by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
}

_OTHER = r"[^0-9A-Za-z\x{80}-\x{10FFFF}\n]+"


def template_words(text: str) -> list[str]:
    return [w.lower() for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)]


def template_rows(templates: dict[str, str]) -> list[tuple[int, str, Counter]]:
    """(number, name, bigrams) of templates of two words or more, in order of names."""
    rows = [(name, template_words(text)) for name, text in sorted(templates.items())]
    return [(i, name, Counter(f"{a} {b}" for a, b in zip(w, w[1:]))) for i, (name, w) in enumerate((n, w) for n, w in rows if len(w) > 1)]


def _literal(rows: list[tuple[int, str, Counter]]) -> Column:
    return F.array(
        *(
            F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(sum(c.values())).alias("m"), F.array(*(F.struct(F.lit(g).alias("g"), F.lit(n).alias("n")) for g, n in c.items())).alias("grams"))
            for i, name, c in rows
        )
    )


def scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of documents and license, dice, unit of the best match.

    unit is 0 for the whole text, a line's number, or for a window minus the number of its first word. n_matches
    counts the pairs of unit and template that reach the threshold. The best has the highest coefficient, then
    the first template by name, then the first of text, lines and windows.

    Cases: null and empty texts, and units of fewer than two words, match nothing (nulls, n_matches 0); a text
    of one line is no whole text; repeated rows are scanned each; without templates nothing matches; the words
    of a text of any length are in memory at once. Columns with the names of new ones are replaced.
    """
    rows = template_rows(TEMPLATES if templates is None else templates)
    new = ("license", "dice", "unit", "n_matches")
    documents = documents.drop(*new)
    if not rows:
        return documents.select("*", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), F.lit(None).cast("int").alias("unit"), F.lit(0).alias("n_matches"))
    # sizes that no template allows; the slack is for rounding
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    least, most = min(sum(c.values()) for *_, c in rows) * low, max(sum(c.values()) for *_, c in rows) * high
    literal = _literal(rows)

    def with_count(line: Column, i: Column) -> Column:
        line = F.trim(line)
        words = F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
        return F.struct((i + 1).alias("unit"), line.alias("line"), (words - 1).alias("n"))

    def with_whole(lines: Column) -> Column:
        """Lines and, if there are several and its size allows, the whole text as unit 0."""
        full = F.filter(lines, lambda x: x["n"] >= 0)
        n = F.aggregate(full, F.lit(-1), lambda acc, x: acc + x["n"] + 1)
        whole = F.struct(F.lit(0).alias("unit"), F.array_join(F.transform(full, lambda x: x["line"]), " ").alias("line"), n.alias("n"))
        fits = (F.size(lines) > 1) & (n >= least) & (n <= most)
        return F.when(fits, F.array_append(lines, whole)).otherwise(lines)

    known = sorted({g for *_, c in rows for g in c})

    def with_grams(u: Column) -> Column:
        words = F.split(u["line"], " ")
        grams = F.zip_with(F.slice(words, 1, u["n"]), F.slice(words, 2, u["n"]), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.struct(u["unit"].alias("unit"), u["n"].alias("n"), F.filter(grams, lambda g: g.isin(known)).alias("grams"))

    def compared(u: Column) -> Column:
        most_common = lambda t: F.least(u["n"], t["m"], F.size(u["grams"]))
        fit = F.filter(literal, lambda t: F.lit(2.0) * most_common(t) / (u["n"] + t["m"]) >= threshold)

        def match(t: Column) -> Column:
            common = F.aggregate(t["grams"], F.lit(0), lambda acc, g: acc + F.least(g["n"], F.size(F.filter(u["grams"], lambda x: x == g["g"]))))
            return F.struct((F.lit(2.0) * common / (u["n"] + t["m"])).alias("dice"), (-t["i"]).alias("i"), (-u["unit"]).alias("order"), u["unit"].alias("unit"), t["name"].alias("license"))

        return F.transform(fit, match)

    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is evaluated once

    def windows(words: Column) -> Column:
        """Matches of windows of words, of all templates of which the text has enough bigrams."""
        total = F.size(words) - 1
        grams = F.zip_with(F.slice(words, 1, F.greatest(total, F.lit(0))), F.slice(words, 2, F.greatest(total, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        marked = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("at"))), lambda x: x["g"].isin(known))

        def in_text(marked: Column) -> Column:
            def of_template(t: Column) -> Column:
                names = F.transform(t["grams"], lambda g: g["g"])
                return bound(F.filter(marked, lambda x: F.array_contains(names, x["g"])), lambda own: F.transform(own, lambda x, k: at_start(t, own, x, k)))

            def at_start(t: Column, own: Column, x: Column, k: Column) -> Column:
                n = F.least(t["m"], total - x["at"])
                # a window has at most m of the bigrams that follow
                inside = F.filter(F.slice(own, k + 1, t["m"]), lambda y: y["at"] < x["at"] + t["m"])

                def scored(inside: Column) -> Column:
                    common = F.aggregate(t["grams"], F.lit(0), lambda acc, g: acc + F.least(g["n"], F.size(F.filter(inside, lambda y: y["g"] == g["g"]))))
                    common = F.when(F.lit(2.0) * F.size(inside) / (n + t["m"]) >= threshold, common).otherwise(0)
                    unit = -x["at"] - 1
                    return F.struct((F.lit(2.0) * common / (n + t["m"])).alias("dice"), (-t["i"]).alias("i"), (unit - (1 << 30)).alias("order"), unit.alias("unit"), t["name"].alias("license"))

                return bound(inside, scored)

            def enough(seen: Column) -> Column:
                there = lambda t: F.aggregate(t["grams"], F.lit(0), lambda acc, g: acc + F.when(F.array_contains(seen, g["g"]), g["n"]).otherwise(0))
                return F.filter(literal, lambda t: there(t) >= low * t["m"])

            # few texts have enough bigrams of any template
            fit = bound(F.array_distinct(F.transform(marked, lambda x: x["g"])), enough)
            return F.flatten(F.transform(fit, of_template))

        return bound(marked, in_text)

    text = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), _OTHER, " "))
    lines = F.transform(F.array(F.transform(F.split(text, "\n"), with_count)), with_whole)[0]
    chosen = F.filter(lines, lambda u: (u["n"] >= least) & (u["n"] <= most))
    matches = F.flatten(F.transform(F.transform(chosen, with_grams), compared))
    words = F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    matches = F.concat(matches, bound(words, windows))
    found = documents.withColumn("__m", F.filter(matches, lambda m: m["dice"] >= threshold))
    best = F.transform(F.array("__m"), lambda m: F.struct(F.array_max(m).alias("best"), F.size(m).alias("n")))[0]
    found = found.withColumn("__m", best)
    return found.select(*documents.columns, F.col("__m.best.license").alias("license"), F.col("__m.best.dice").alias("dice"), F.col("__m.best.unit").alias("unit"), F.col("__m.n").alias("n_matches"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    from linkrain.llm.common import table

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{g}', {n})" for i, name, c in template_rows(TEMPLATES) for g, n in c.items())
    return f"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, lower(regexp_replace(coalesce(text, ''), '{_OTHER}', ' ', 'g')) AS t FROM documents),
    grams AS (SELECT * FROM (VALUES {rows}) AS v(i, name, g, k)),
    sizes AS (SELECT i, any_value(name) AS name, sum(k)::INT AS m FROM grams GROUP BY i),
    lines AS (SELECT r, string_split(t, chr(10)) AS ls, t FROM docs),
    units AS (
      SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS unit FROM lines
      UNION ALL SELECT r, regexp_replace(replace(t, chr(10), ' '), ' +', ' ', 'g'), 0 FROM lines WHERE len(ls) > 1),
    split AS (SELECT r, unit, string_split(trim(line), ' ') AS w FROM units),
    fit AS (SELECT r, unit, w, len(w) - 1 AS n, i, name, m FROM split JOIN sizes ON len(w) > 1 AND 2.0::DOUBLE * least(len(w) - 1, m) / (len(w) - 1 + m) >= {THRESHOLD!r}::DOUBLE),
    own AS (SELECT r, unit, i, g, count(*) AS c FROM (SELECT r, unit, i, unnest(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) AS g FROM fit) GROUP BY ALL),
    common AS (SELECT r, unit, i, sum(least(c, k)) AS s FROM own JOIN grams USING (i, g) GROUP BY ALL),
    words AS (SELECT r, list_filter(string_split(replace(t, chr(10), ' '), ' '), lambda x: x != '') AS w FROM docs),
    pairs AS (SELECT r, len(w) - 1 AS total, unnest(range(1, len(w))) AS p, unnest(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) AS g FROM words),
    own_pairs AS (SELECT r, total, p, pairs.g, i, k, m FROM pairs JOIN grams USING (g) JOIN sizes USING (i)),
    starts AS (SELECT r, p, i, m, least(m, total - p + 1) AS n FROM own_pairs),
    inside AS (SELECT s.r, s.p, s.i, any_value(s.m) AS m, any_value(s.n) AS n, o.g, least(count(*), any_value(o.k)) AS c
      FROM starts s JOIN own_pairs o ON o.r = s.r AND o.i = s.i AND o.p >= s.p AND o.p < s.p + s.m GROUP BY s.r, s.p, s.i, o.g),
    placed AS (SELECT r, -p AS unit, i, any_value(m) AS m, any_value(n) AS n, sum(c) AS s FROM inside GROUP BY r, p, i),
    match AS (
      SELECT fit.r, fit.unit, fit.i, name, 2.0::DOUBLE * s::DOUBLE / (n + m) AS dice FROM fit JOIN common USING (r, unit, i) WHERE 2.0::DOUBLE * s::DOUBLE / (n + m) >= {THRESHOLD!r}::DOUBLE
      UNION ALL SELECT placed.r, unit, placed.i, name, 2.0::DOUBLE * s::DOUBLE / (n + placed.m) FROM placed JOIN sizes USING (i) WHERE 2.0::DOUBLE * s::DOUBLE / (n + placed.m) >= {THRESHOLD!r}::DOUBLE),
    best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, i, unit < 0, abs(unit)) AS place, count(*) OVER (PARTITION BY r) AS n_matches FROM match)
    SELECT doc_id, name AS license, dice, unit::INT AS unit, coalesce(n_matches, 0)::INT AS n_matches FROM docs LEFT JOIN (SELECT * FROM best WHERE place = 1) AS b USING (r)
    """


ORACLE_SQL = _sql()
