"""Licence scans: normalised text against notice templates by Dice coefficient over sets of word bigrams.

Native DataFrame operations only.  A unit is a line, a paragraph (where a text has blank lines) or a whole text.  With
``a`` and ``b`` distinct bigrams, a coefficient of ``threshold`` needs ``a`` between ``b t / (2 - t)`` and
``b (2 - t) / t``; the templates are laid out by every size they allow, so candidates come from an equality join on the
unit's size, and units beyond all sizes are dropped before their bigrams are made.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence names and their public notices.
TEMPLATES = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_sizes(threshold: float) -> list[tuple[str, list[str], int, int]]:
    """Rows (licence, its distinct bigrams, their number, a size of units that may reach the threshold)."""
    rows = []
    for name, notice in TEMPLATES:
        words = re.sub("[^a-z0-9]+", " ", notice.lower()).split()
        grams = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
        n = len(grams)
        rows += [(name, grams, n, size) for size in range(math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1)]
    return rows


def _units(plain: Column, least: int, most: int) -> Column:
    """Distinct word bigrams of the lines, paragraphs and the whole of a normalised text, each with its kind and number
    (from 0), where their number may lie between ``least`` and ``most``.  Each step binds what the next one repeats."""
    several = F.instr(plain, "\n") > 0
    lines = F.split(plain, "\n")
    paragraphs = F.when(plain.rlike("\n ?\n"), F.split(plain, "\n ?\n[\n ]*"))
    whole = F.when(several, F.array(plain))
    worded = lambda u: F.split(F.trim(F.translate(u, "\n", " ")), " +").alias("w")
    tagged = lambda kind, units: F.transform(F.coalesce(units, F.array().cast("array<string>")), lambda u, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), worded(u)))
    # So many distinct words make at least one distinct bigram less, so many words at most one bigram less.
    sized = F.filter(F.concat(tagged("line", lines), tagged("paragraph", paragraphs), tagged("text", whole)), lambda x: (F.size(x["w"]) > least) & (F.size(F.array_distinct(x["w"])) <= most + 1))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.transform(sized, lambda x: F.struct(x["unit"].alias("unit"), x["unit_no"].alias("unit_no"), F.array_distinct(pairs(x["w"])).alias("grams")))


def scan(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, unit, unit_no, license, dice)`` for every unit and template at ``threshold`` or more.

    A licence with several notices may match by each.  Null and empty texts have no matches; null and repeated ids
    come back as they are, repeated rows give repeated matches.  Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    templates = spark.createDataFrame(template_sizes(threshold), "license string, template array<string>, b int, a int")
    least, most = (f(r[3] for r in template_sizes(threshold)) for f in (min, max))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), "[^a-z0-9\n]+", " ").alias("plain"))
    grams = plain.select("doc_id", F.explode(_units(F.col("plain"), least, most)).alias("u")).select("doc_id", "u.unit", "u.unit_no", "u.grams", F.size("u.grams").alias("a"))
    scored = grams.join(F.broadcast(templates), "a").withColumn("shared", F.size(F.array_intersect("grams", "template")))
    dice = scored.withColumn("dice", 2.0 * F.col("shared") / (F.col("a") + F.col("b"))).filter(F.col("dice") >= threshold)
    return dice.select("doc_id", "unit", "unit_no", "license", "dice")


def oracle_sql(threshold: float = 0.8) -> str:
    """The same scan for DuckDB over the view ``documents``."""
    notices = ", ".join("('{}', '{}')".format(name, notice.replace("'", "''")) for name, notice in TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH plain AS (
  SELECT doc_id, regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') AS p FROM documents WHERE text IS NOT NULL
), parts AS (
  SELECT doc_id, 'line' AS unit, string_split(p, chr(10)) AS us FROM plain
  UNION ALL SELECT doc_id, 'paragraph', regexp_split_to_array(p, '\\n ?\\n[\\n ]*') FROM plain WHERE regexp_matches(p, '\\n ?\\n')
  UNION ALL SELECT doc_id, 'text', [p] FROM plain WHERE contains(p, chr(10))
), units AS (
  SELECT doc_id, unit, unnest(us) AS u, unnest(range(len(us))) AS unit_no FROM parts
), worded AS (
  SELECT doc_id, unit, unit_no, regexp_split_to_array(trim(translate(u, chr(10), ' ')), ' +') AS w FROM units
), grams AS (
  SELECT doc_id, unit, unit_no, {grams} AS g FROM worded WHERE len(w) > 1
), templates AS (
  SELECT license, {grams} AS g FROM (
    SELECT license, regexp_split_to_array(trim(regexp_replace(lower(notice), '[^a-z0-9]+', ' ', 'g')), ' +') AS w
    FROM (VALUES {notices}) AS t(license, notice))
)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, license, 2.0::DOUBLE * len(list_intersect(d.g, t.g)) / (len(d.g) + len(t.g)) AS dice
FROM grams d, templates t
WHERE len(d.g) <= 400 AND 2.0::DOUBLE * len(list_intersect(d.g, t.g)) / (len(d.g) + len(t.g)) >= {threshold}
"""
