"""License scans with DataFrame functions only.

Each line, each paragraph and each run of two to ``RUN`` paragraphs of a text is normalised and compared with license templates by the
Dice coefficient of their sets of word pairs; a unit carries the license of its best template only, so that siblings (GPL and LGPL,
versions, CC variants) don't come along. Size bounds prune: a Dice of ``t`` needs ``t / (2 - t)`` of a template's pairs, so a unit must hold at least one of any
sufficiently large choice of them (one regular expression for all templates skips most texts), and its own number of pairs must lie
between ``t / (2 - t)`` and ``(2 - t) / t`` of the template's.

Defined results: a null or empty text has no license; repeated rows each get their row; a tie between templates goes to the first
name; an empty table gives no rows; other columns keep their values, whatever they are called (one called found is replaced). Long
texts take time in proportion to their length, and only those with a chosen pair are compared at all.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, table

THRESHOLD = 0.8
#: Paragraphs in a row that are compared together, as notices have their clauses in paragraphs of their own.
RUN = 4

# Notices by which works state their license, as published with the licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def normalise(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_rows() -> list[tuple[str, list[str]]]:
    """(name, distinct word pairs), each template text a row."""
    out = []
    for name in sorted(TEMPLATES):
        for text in TEMPLATES[name]:
            w = normalise(text)
            out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))))
    return out


def pruning_pattern(threshold: float = THRESHOLD) -> str:
    """A pattern that every unit with a Dice of ``threshold`` or more to some template matches.

    Such a unit has at least ``threshold / (2 - threshold)`` of the template's pairs, so of one more than the rest it has one.
    """
    chosen: dict[str, None] = {}
    for _, pairs in template_rows():
        n = len(pairs) - math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9) + 1
        # Pairs chosen before come first, then long ones: few alternatives, seldom found in other text.
        for p in sorted(pairs, key=lambda p: (p not in chosen, -len(p), p))[:n]:
            chosen[p] = None
    return r"\b(?:" + "|".join(sorted(chosen)) + r")\b"


def _norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with found: array of (license, dice), the best template of every unit that reaches ``threshold``."""
    rows = template_rows()
    templates = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, p)).alias("pairs")) for n, p in rows])
    pattern = pruning_pattern(threshold)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    df = apart(docs, t=F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("n", _norm(F.col("t")))
    df = df.withColumn("some", F.col("n").rlike(pattern))
    none = F.array().cast("array<string>")
    df = df.withColumn("paragraphs", F.when(F.col("some"), F.filter(F.transform(F.split("t", r"\n[\x20\x09\x0D]*\n"), _norm), lambda x: x != "")).otherwise(none))
    def run(k: int) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size("paragraphs") - (k - 1)), lambda i: F.array_join(F.slice("paragraphs", i, k), " "))
        return F.when(F.size("paragraphs") >= k, several).otherwise(none)

    runs = [run(k) for k in range(2, RUN + 1)]
    units = F.array_distinct(F.concat(F.transform(F.split("t", "\n"), _norm), F.col("paragraphs"), *runs))
    df = df.withColumn("units", F.when(F.col("some"), F.filter(units, lambda u: u.rlike(pattern))).otherwise(none))
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    df = df.withColumn("sets", F.transform("units", lambda u: F.struct(pairs(F.split(u, " ")).alias("p"))))
    dice = lambda p, t: F.when(F.size(p).between(F.ceil(low * F.size(t["pairs"]) - 1e-9), F.floor(high * F.size(t["pairs"]) + 1e-9)), 2.0 * F.size(F.array_intersect(p, t["pairs"])) / (F.size(p) + F.size(t["pairs"])))
    best = lambda u: F.array_min(F.filter(F.transform(templates, lambda t: F.struct((-dice(u["p"], t)).alias("less"), t["license"].alias("license"))), lambda x: x["less"] <= -threshold))
    found = F.transform(F.filter(F.transform("sets", best), lambda x: x.isNotNull()), lambda x: F.struct(x["license"].alias("license"), (-x["less"]).alias("dice")))
    df = df.withColumn("found", F.when(F.size("sets") > 0, found).otherwise(F.array().cast("array<struct<license:string,dice:double>>")))
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "found"], "found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.get(F.sort_array(F.transform("found", lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("license")))), 0)
    return df.select(
        "doc_id", F.size("found").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.coalesce(best["license"], F.lit("")).alias("best_license"), F.round(F.coalesce(-best["d"], F.lit(0.0)), 6).alias("best_dice"),
    )


def _oracle() -> str:
    values = ", ".join("('%s', [%s])" % (n, ", ".join(f"'{x}'" for x in p)) for n, p in template_rows())
    return rf"""
WITH t(license, pairs) AS (VALUES {values}),
tt AS (SELECT row_number() OVER () AS tid, license, pairs FROM t),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n[\x20\x09\x0D]*\n'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS q FROM d),
u AS (SELECT DISTINCT doc_id, unit FROM (
      SELECT doc_id, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS unit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)
      UNION ALL SELECT doc_id, array_to_string(q[i : i + k - 1], ' ') AS unit FROM (SELECT doc_id, q, k, unnest(range(1, len(q) - k + 2)) AS i FROM g, (SELECT unnest(range(1, {RUN + 1})) AS k) WHERE len(q) >= k))),
p AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS pairs FROM (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM u)),
m AS (SELECT doc_id, license, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS best FROM (SELECT doc_id, unit, license, 2.0 * len(list_intersect(p.pairs, tt.pairs)) / (len(p.pairs) + len(tt.pairs)) AS dice FROM p, tt WHERE len(p.pairs) > 0 AND list_has_any(p.pairs, tt.pairs)) WHERE dice >= {THRESHOLD}) WHERE best = 1),
b AS (SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) AS k FROM m),
a AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_matches, coalesce(a.licenses, '') AS licenses, coalesce(b.license, '') AS best_license, round(CAST(coalesce(b.dice, 0) AS DOUBLE), 6) AS best_dice
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (doc_id)
"""


ORACLE = _oracle()
