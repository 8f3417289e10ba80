"""License scans: lines and whole texts against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, durable, text

#: Grant and notice sentences of common public licences.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_MIT = TEMPLATES["MIT-notice"] + """, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_KEEP = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_NO_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = TEMPLATES["ISC"] + """, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = TEMPLATES["Unlicense"] + """
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_TEXTS = Path(__file__).parent / "texts"
#: Whole licences, read with the package on the driver. ``TEMPLATES`` stays as the SQL has it.
FULL_TEXTS: dict[str, str] = {
    "MIT-text": _MIT, "BSD-2-Clause-text": _REDISTRIBUTION + _KEEP + _AS_IS, "BSD-3-Clause-text": _REDISTRIBUTION + _KEEP + _NO_NAMES + _AS_IS, "ISC-text": _ISC, "Unlicense-text": _UNLICENSE,
} | {f"{k}-text": (_TEXTS / f"{v}.txt").read_text() for k, v in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))}


def words(col: Column) -> Column:
    """Lower-case runs of ASCII letters and digits. Every other character separates."""
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(ws: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, unit, dice) for each row and template that matches: the best of the row's lines and its whole text (unit -1).

    Dice is 2 |A and B| / (|A| + |B|) over distinct word bigrams. It reaches
    ``least`` only where the smaller set has at least least / (2 - least) times
    the larger one's bigrams: units outside the templates' size bounds are
    dropped before their bigrams are made, pairs outside them before they are
    scored. Ties within a row go to the lowest unit. The templates (an argument, thus bounded) are broadcast as one row for each of
    their bigrams. Null and empty texts, and lines of fewer than two words,
    match nothing; repeated rows are reported once for each id; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, v) for k, v in templates.items()], "license string, body string")
    known = known.select("license", bigrams(words(F.col("body"))).alias("grams")).select("license", F.size("grams").cast("long").alias("t"), "grams")
    sizes = [r["t"] for r in known.select("t").collect()]
    share = least / (2 - least)
    fewest, most = min(sizes, default=1) * share, max(sizes, default=0) / share
    rows = docs.select(column(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), text(text_col).alias("_text"))
    units = rows.select("_id", "_row", F.posexplode(F.concat(F.array("_text"), F.split("_text", "\n"))).alias("_pos", "_unit"))
    ws = words(F.col("_unit"))
    # a unit of w words, d of them distinct, has at most w - 1 and at least d - 1 distinct bigrams
    units = units.where((F.size(ws) - 1 >= F.lit(fewest)) & (F.size(F.array_distinct(ws)) - 1 <= F.lit(most)))
    units = units.select("_id", "_row", (F.col("_pos") - 1).alias("_pos"), bigrams(ws).alias("_grams"))
    grams = units.select("_id", "_row", "_pos", F.size("_grams").cast("long").alias("n"), F.explode("_grams").alias("gram"))
    table = known.select("license", "t", F.explode("grams").alias("gram"))
    hits = grams.join(F.broadcast(table), "gram").where(F.col("n").between(F.col("t") * share, F.col("t") / share))
    scored = hits.groupBy("_row", "_id", "_pos", "license", "n", "t").agg(F.count("*").alias("both"))
    scored = scored.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("t"))).where(F.col("dice") >= least)
    best = scored.groupBy("_id", "license").agg(F.max_by("_pos", F.struct("dice", -F.col("_pos"))).alias("unit"), F.max("dice").alias("dice"))
    return best.withColumnRenamed("_id", id_col)


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, unit, start, dice): as ``license_scan``, and with runs of words anywhere in the text (unit -2, from word ``start``).

    A run has as many words as the template and takes no notice of lines, so
    that wrapped notices, sentences inside paragraphs and whole licences inside longer
    texts are found. Runs start at every word for templates of up to 80
    words, else at every 40th part of the template's length, which costs at most
    an 80th of Dice beside the best start. Ties go to lines and whole texts. ``templates``: by
    default ``TEMPLATES`` and ``FULL_TEXTS``.

    A run that reaches ``least`` holds least / (2 - least) of the template's
    bigrams, thus one of any third of them: rows without a word of those with
    the longest words are dropped first, rows with too few of the bigrams next;
    only the bigrams of what is left are written.
    """
    templates = TEMPLATES | FULL_TEXTS if templates is None else templates
    spark, share, table, wanted = docs.sparkSession, least / (2 - least), [], set()
    for name, body in templates.items():
        ws = re.findall("[a-z0-9]+", body.lower())
        grams = sorted(set(zip(ws, ws[1:], strict=False)), key=lambda g: (-max(map(len, g)), g))
        if grams:
            wanted |= {max(g, key=len) for g in grams[: math.floor(len(grams) * (1 - share) + 1e-9) + 1]}
            table += [(name, " ".join(g), len(grams), len(ws) - 1, 1 if len(ws) <= 80 else (len(ws) - 1) // 40) for g in grams]
    table = spark.createDataFrame(table, "license string, gram string, t long, span int, stride int")
    found = license_scan(docs, templates, least, id_col, text_col).select(column(id_col).alias("_id"), "license", "unit", F.lit(None).cast("int").alias("start"), "dice")
    key = ["_none", "_sid", "_key"]
    rows = docs.select(column(id_col).alias("_id"), column(id_col).isNull().alias("_none"), F.coalesce(column(id_col).cast("string"), F.lit("")).alias("_sid"), F.xxhash64(text(text_col)).alias("_key"), words(text(text_col)).alias("_words"))
    rows = rows.where(F.arrays_overlap("_words", F.array(*map(F.lit, sorted(wanted))))).where(F.size("_words") > 1)
    after = F.slice("_words", 2, F.size("_words") - 1)
    rows = rows.withColumn("_grams", F.zip_with(F.slice("_words", 1, F.size("_words") - 1), after, lambda a, b: F.concat_ws(" ", a, b))).drop("_words")
    held = rows.select(*key, F.explode(F.array_distinct("_grams")).alias("gram")).join(F.broadcast(table), "gram").groupBy(*key, "license", "t").agg(F.count_distinct("gram").alias("both"))
    enough = durable(held.where(F.col("both") >= F.col("t") * share - 1e-9).select(*key, "license"))
    rows = rows.join(enough.select(*key).distinct(), key, "left_semi").dropDuplicates(key)
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()))  # of the few texts that hold enough of a licence
    hits = rows.select("_row", *key, F.posexplode("_grams").alias("p", "gram")).join(F.broadcast(table), "gram").join(enough, [*key, "license"])
    first = F.greatest(F.ceil((F.col("p") - F.col("span") + 1) / F.col("stride")), F.lit(0)).cast("int")
    runs = hits.withColumn("k", F.explode(F.sequence(first, F.floor(F.col("p") / F.col("stride")).cast("int"))))
    runs = runs.groupBy("_row", "license", "t", "span", (F.col("k") * F.col("stride")).alias("start")).agg(F.count_distinct("gram").alias("both"))
    runs = runs.where(F.col("both") >= F.col("t") * share - 1e-9).join(rows, "_row")
    n = F.size(F.array_distinct(F.slice("_grams", F.col("start") + 1, F.col("span"))))
    runs = runs.select("_id", "license", F.lit(-2).alias("unit"), "start", (2.0 * F.col("both") / (n + F.col("t"))).alias("dice")).where(F.col("dice") >= least)
    order = F.struct("dice", F.col("unit") >= -1, -F.coalesce("start", "unit"))
    best = found.unionByName(runs).groupBy("_id", "license").agg(F.max_by(F.struct("unit", "start", "dice"), order).alias("b"))
    return best.select(F.col("_id").alias(id_col), "license", "b.unit", "b.start", "b.dice")
