"""License scans: MinHash bands over overlapping word windows, then exact containment.

Texts become lower-case words; shingles are five words.  For a template of m
shingles every text is looked at through windows of m shingles that start every
``max(1, m // 8)`` words, so some window is shifted by m / 16 at most.  A window
retrieves the template when all rows of a MinHash band agree, that is, when the
band's smallest shingles under its permutations are the template's.  If 0.8 of a
template's shingles are there, the nearest window has Jaccard similarity 0.58 or
more, and 16 bands of 2 rows miss it with a chance of (1 - 0.58**2)**16 < 0.2 %;
a template of up to eight shingles meets a window with no shift, below 0.01 %.

Only a window that holds a template's smallest shingle can agree, so texts with
none of these shingles, nearly all, stop after one set intersection, and only
windows around such shingles are hashed.  What is retrieved is verified: the
share of the template's shingles, compared as words, that stand in the window
widened by one step.  Licenses that share their wording are told apart twice: a
place must hold the words that name its version and family, and of places of
different licenses on the same words the one with the most shingles stays.
Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 16
ROWS = 2
_WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"

#: Notices and opening paragraphs of public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    (
        "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    (
        "CC-BY-NC-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International "
        "License.",
    ),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not "
        "use this file except in compliance with the License.",
    ),
    (
        "EPL-1.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "v1.0 which accompanies this distribution.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software",
    ),
    (
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
)

#: What the words of a place, joined by spaces, must hold to carry the name of
#: a license whose wording others share but for its version or family.
TELLING = {
    "Apache-2.0": r"apache license version 2\.0( |$)",
    "GPL-2.0": r"gnu general public license .*version 2(\.0)?( |$)",
    "GPL-3.0": r"gnu general public license .*version 3(\.0)?( |$)",
    "LGPL-2.1": r"gnu lesser general public license .*version 2\.1( |$)",
    "LGPL-3.0": r"gnu lesser general public license .*version 3(\.0)?( |$)",
    "AGPL-3.0": r"gnu affero general public license .*version 3(\.0)?( |$)",
    "CC-BY-4.0": r"(attribution|cc by) 4\.0( |$)",
    "CC-BY-3.0": r"(attribution|cc by) 3\.0( |$)",
    "CC-BY-SA-4.0": r"(attribution-sharealike|cc by-sa) 4\.0( |$)",
    "CC-BY-SA-3.0": r"(attribution-sharealike|cc by-sa) 3\.0( |$)",
    "CC-BY-ND-4.0": r"(attribution-noderivatives|cc by-nd) 4\.0( |$)",
    "CC-BY-NC-4.0": r"(attribution-noncommercial|cc by-nc) 4\.0( |$)",
    "CC-BY-NC-SA-4.0": r"(attribution-noncommercial-sharealike|cc by-nc-sa) 4\.0( |$)",
    "CC-BY-NC-ND-4.0": r"(attribution-noncommercial-noderivatives|cc by-nc-nd) 4\.0( |$)",
    "MPL-2.0": r"mozilla public license (v|version) 2\.0( |$)",
    "MPL-1.1": r"mozilla public license version 1\.1( |$)",
    "EPL-1.0": r"eclipse public license (v1|v 1|version 1|1)\.0( |$)",
    "EPL-2.0": r"eclipse public license (v2|v 2|version 2|2)\.0( |$)",
    "OFL-1.1": r"open font license version 1\.1( |$)",
    "CC0-1.0": r"(cc0 1\.0|waived all copyright)( |$)",
}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _shingles(words: Column) -> Column:
    """Hashes of all five-word runs; none for fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    every = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, every).otherwise(F.array().cast("array<bigint>"))


def _once(value: Column) -> Column:
    """The value as a generated column: later filters can't copy its expression into themselves."""
    return F.explode(F.array(value))


def _named(words: Column, low: Column, count: Column) -> Column:
    """The five-word runs that start at ``low`` and the ``count - 1`` next words, as text."""
    at = F.filter(F.sequence(low, low + count - 1), lambda i: i + SHINGLE <= F.size(words))
    return F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(SHINGLE))))


def _smallest(hashes: Column) -> Column:
    """For every row of all bands, the hash that comes first under the row's permutation."""

    def first(row: Column) -> Column:
        ranked = F.transform(hashes, lambda h: F.struct(F.xxhash64(h, row).alias("r"), h.alias("h")))
        return F.array_min(ranked)["h"]

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), first)


def template_table(spark: SparkSession, templates=TEMPLATES, telling=TELLING) -> DataFrame:
    """``number, license, telling, m, step, shingles, mins`` of every template, from its text.

    A template of fewer than five words can't be found, and is refused.
    """
    given = [(i, name, telling.get(name, ""), text) for i, (name, text) in enumerate(templates)]
    rows = spark.createDataFrame(given, "number int, license string, telling string, text string")
    rows = rows.withColumn("words", _words(F.col("text"))).withColumn("hashes", _shingles(F.col("words")))
    return rows.select(
        "number",
        "license",
        "telling",
        F.size("hashes").alias("m"),
        F.greatest(F.lit(1), F.floor(F.size("hashes") / 8).cast("int")).alias("step"),
        F.array_distinct(_named(F.col("words"), F.lit(0), F.size("words") - SHINGLE + 1)).alias("shingles"),
        _smallest(F.col("hashes")).alias("mins"),
    )


def _literal(row) -> Column:
    numbers = F.array(*[F.lit(x).cast("bigint") for x in row["mins"]])
    names = F.array(*map(F.lit, row["shingles"]))
    fields = {name: F.lit(row[name]) for name in ("number", "license", "telling", "m", "step")}
    fields |= {"shingles": names, "mins": numbers}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _best_licenses(places: DataFrame, reach: int) -> DataFrame:
    """Places that no place of another license beats on the same words.

    Two places contest where they share half of the shorter one's words; the one with more
    of its template's shingles stays (then the higher containment, then the first name).
    A place is ``reach`` words long at most, and a license has no two places that overlap, so
    the neighbours of a place are some per license, however long the text is.
    """
    near = Window.partitionBy("doc_id", "text_hash").orderBy("start_word").rangeBetween(-reach, reach)
    fields = ("license", "start_word", "end_word", "matched", "containment")
    rival = F.collect_list(F.struct(*fields)).over(near)

    def beats(o: Column) -> Column:
        shared = F.least(o["end_word"], F.col("end_word")) - F.greatest(o["start_word"], F.col("start_word"))
        shorter = F.least(o["end_word"] - o["start_word"], F.col("end_word") - F.col("start_word"))
        same = (o["matched"] == F.col("matched")) & (o["containment"] == F.col("containment"))
        more = (o["matched"] > F.col("matched")) | (
            (o["matched"] == F.col("matched")) & (o["containment"] > F.col("containment"))
        )
        return (o["license"] != F.col("license")) & (2 * shared >= shorter) & (
            more | (same & (o["license"] < F.col("license")))
        )

    return places.withColumn("rivals", rival).where(~F.exists("rivals", beats)).drop("rivals")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, percent: int = 80, telling=TELLING) -> DataFrame:
    """``doc_id, license, start_word, end_word, containment``: a row for each place of a license.

    A place is a window in which at least ``percent`` % of a template's distinct
    shingles stand, and the ``telling`` pattern of its license, if it has one; windows
    of one license that overlap are one place, shown by the one that holds most of a
    template's shingles (then the highest containment, then the first).  Where places of
    different licenses share half of the shorter one's words, those that hold fewer
    shingles of their template go, so a text is named by the closest wording.  Words
    count from 0, ``end_word`` is behind the last one.  ``BSD`` is the opening that the
    BSD licenses share, where the clauses that tell them apart don't follow.

    NULL, empty and short texts have no place; rows that repeat doc_id and text
    are one document, and a NULL doc_id stays NULL.  Other columns are ignored, an
    empty table gives no rows.  ``templates`` are (license, text)
    pairs; they become literals of the plan and are meant to be some hundreds at most.
    """
    # the templates are parameters, not data
    rows = template_table(docs.sparkSession, templates, telling).collect()
    if short := [r["license"] for r in rows if not r["m"]]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    wanted = F.array(*[F.lit(x).cast("bigint") for x in sorted({x for r in rows for x in r["mins"]})])
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _once(_words(F.col("text"))).alias("words"))
    texts = texts.select("*", _once(_shingles(F.col("words"))).alias("hashes"))
    hit = texts.select("*", _once(F.array_intersect("hashes", wanted)).alias("hits")).where(F.size("hits") > 0)
    # only templates that have one of the text's shingles among their smallest are set beside it
    met = F.filter(F.array(*map(_literal, rows)), lambda t: F.arrays_overlap(F.col("hits"), t["mins"]))
    each = hit.select("*", F.explode(met).alias("t")).drop("hits")
    h, m, step, last = F.col("hashes"), F.col("t.m"), F.col("t.step"), F.greatest(F.size("hashes") - F.col("t.m"), F.lit(0))
    near = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda p: F.array_contains("t.mins", F.get(h, p)))
    # grid starts of windows that hold such a shingle, and the last window of the text
    grid = F.flatten(
        F.transform(
            near,
            lambda p: F.filter(
                F.sequence(F.least(F.greatest(p - m + 1, F.lit(0)), last), F.least(p, last)),
                lambda i: (i % step == 0) | (i == last),
            ),
        )
    )
    each = each.select("*", F.explode(F.array_distinct(grid)).alias("start"))
    each = each.select("*", _once(_smallest(F.slice(h, F.col("start") + 1, m))).alias("firsts"))
    agree = F.exists(
        F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1), F.lit(ROWS)),
        lambda i: F.slice("firsts", i + 1, F.lit(ROWS)) == F.slice("t.mins", i + 1, F.lit(ROWS)),
    )
    each = each.where(agree).drop("firsts")
    low = F.greatest(F.col("start") - step, F.lit(0))
    count = F.col("start") + m + step - low
    found = F.size(F.array_intersect(_named(F.col("words"), low, count), F.col("t.shingles")))
    told = F.regexp_like(F.concat_ws(" ", F.slice("words", low + 1, count + (SHINGLE - 1))), F.col("t.telling"))
    each = each.select(
        "doc_id",
        "text_hash",
        "t.license",
        F.col("start").alias("start_word"),
        F.least(F.col("start") + m + (SHINGLE - 1), F.size("words")).alias("end_word"),
        _once(found).alias("matched"),
        F.size("t.shingles").alias("of"),
        told.alias("told"),
    )
    each = each.where("told").withColumn("containment", F.col("matched") / F.col("of"))
    each = each.where(F.col("containment") * 100 >= percent)
    key = ["doc_id", "text_hash", "license"]
    order = Window.partitionBy(*key).orderBy("start_word", "end_word")
    reached = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start_word") >= reached, F.lit(True)).cast("int")
    placed = each.withColumn("fresh", fresh).withColumn("place", F.sum("fresh").over(order))
    shown = F.struct("start_word", "end_word", "matched", "containment")
    best = F.max_by(shown, F.struct("matched", "containment", -F.col("start_word"), "end_word"))
    places = placed.groupBy(*key, "place").agg(best.alias("best")).select(*key, "best.*")
    reach = max((r["m"] for r in rows), default=0) + SHINGLE - 1
    return _best_licenses(places, reach).select("doc_id", "license", "start_word", "end_word", "containment")
