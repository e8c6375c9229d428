"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: License notices and whole license texts that are looked for, in the words of their publishers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "GPL-3.0-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "AGPL-3.0-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works",
    "LGPL-3.0-text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.""",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-whole": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-whole": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced or distributed without permission.",
}
#: Signs that part words, and signs cut off both ends of a word: marks of sentences, quotes and comments. Dots within stay, as in version numbers.
PARTS, ENDS = r"[\x09-\x0D\x20,;:()\"]+", ".!?'`*#/<>[]{}"
#: Words of a window, step between windows, bands of one MinHash each, share of a template's shingles that must be found.
#: A segment of up to WINDOW - STEP + 1 = 9 words lies whole within some window; a template of w words then has Jaccard
#: similarity (w - 1) / (WINDOW - 1) at least with it, so w = 5 is missed with chance (1 - 4/15) ** 32 < 1e-4, w = 7 with 1e-7.
#: Windows of a longer template are indexed at every word, so they meet the document's windows nearly or wholly equal.
WINDOW, STEP, BANDS, CONTAINED = 16, 8, 32, 0.8
#: Templates that share this part of the larger one's distinct pairs are rivals for a stretch.
RIVALS = 0.5
#: Masks of the hash orders: order p puts x before y where x ^ mask is less than y ^ mask.
MASKS = tuple(random.Random(20).sample(range(1 << 62), BANDS))


def tokens(text):
    """The lower-case words, hashed; see PARTS and ENDS."""
    cut = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), PARTS), lambda w: F.btrim(w, F.lit(ENDS)))
    return F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w))


def paired(texts: DataFrame) -> DataFrame:
    """texts (id, text) to (id, pairs): the hashes of neighbouring words, in order."""
    known = texts.select("id", tokens(F.col("text")).alias("words")).filter(F.size("words") > 1)
    n, low = F.size("words") - 1, F.lit((1 << 62) - 1)
    pair = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.xxhash64(a, b).bitwiseAND(low))
    return known.select("id", pair.alias("pairs"))


def windows(docs: DataFrame, step: int = STEP) -> DataFrame:
    """docs (id, pairs) to a row (id, at, pairs) for each window: the pairs of WINDOW words every `step` words, the last may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("pairs") - (WINDOW - step), F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(F.col("pairs"), i + 1, F.lit(WINDOW - 1)).alias("pairs")))
    return docs.select("id", F.explode(cut).alias("w")).select("id", "w.at", "w.pairs")


def bands(cut: DataFrame) -> DataFrame:
    """Rows (id, at, pairs, m), BANDS of them for each window: m is the least pair hash in one of the hash orders."""
    wide = cut.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in MASKS])))
    return wide.select("id", "at", "pairs", F.least(*[F.get("pairs", F.lit(i)).bitwiseXOR(F.col("_mask")) for i in range(WINDOW - 1)]).alias("m"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(key, license, first_word, containment): each template a document holds, the place of its best stretch, containment.

    Windows that share a band with a window of a template are candidates. Verified where at least `contained` of the
    template's distinct word pairs stand in the candidates within a stretch of twice the template's length; stretches
    overlap by half, so none is cut. Of templates alike in RIVALS of their pairs, such as those of one family, a stretch
    holds those of the greatest containment. Words need not keep their end marks. Rows with the same key count as one
    document's; null and empty texts hold none, an empty table gives no rows; extra columns are ignored. The templates'
    bands are a fixed table of some megabytes, BANDS rows for each of their words at most, which is broadcast.
    """
    spark = docs.sparkSession
    listed = F.array(*[F.struct(F.lit(name).alias("id"), F.lit(body).alias("text")) for name, body in templates.items()])
    given = paired(spark.range(1).select(F.inline(listed)))
    own = bands(windows(given, 1)).select("m", F.col("id").alias("license")).distinct()
    sized = given.select(F.col("id").alias("license"), F.greatest(F.size("pairs") + 1, F.lit(WINDOW)).alias("long"), F.array_distinct("pairs").alias("whole"))
    whole = sized.select("license", F.explode("whole").alias("pair"), F.size("whole").alias("n"))
    common = whole.join(whole.select("pair", F.col("license").alias("rival"), F.col("n").alias("m")), "pair").filter("license != rival")
    alike = common.groupBy("license", "rival").agg((F.count("*") / F.greatest(F.first("n"), F.first("m"))).alias("share")).filter(F.col("share") >= RIVALS)
    sized = sized.join(alike.groupBy("license").agg(F.collect_set("rival").alias("rivals")), "license", "left")
    found = bands(windows(paired(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))))).join(F.broadcast(own), "m")
    hits = found.join(F.broadcast(sized), "license").select("id", "license", "at", "long", F.size("whole").alias("n"), F.array_intersect("whole", "pairs").alias("both"))
    stretch = F.explode(F.array(F.floor(F.col("at") / (2 * F.col("long"))) * 2, F.floor((F.col("at") + F.col("long")) / (2 * F.col("long"))) * 2 + 1)).alias("stretch")
    rows = hits.select("id", "license", "at", "n", stretch, F.explode("both").alias("pair"))
    share = rows.groupBy("id", "license", "stretch").agg((F.count_distinct("pair") / F.first("n")).alias("share"), F.min("at").alias("at"))
    best = share.filter(F.col("share") >= contained).groupBy("id", "license").agg(F.max(F.struct("share", (-F.col("at")).alias("back"))).alias("b"))
    best = best.select("id", "license", "b.share", (-F.col("b.back")).alias("at")).join(F.broadcast(sized.select("license", "long", "rivals")), "license")
    held = best.groupBy("id").agg(F.collect_list(F.struct("license", "share", "at", "long", "rivals")).alias("held"))  # one entry for each template at most

    def beaten(x):
        near = lambda y: (F.abs(y["at"] - x["at"]) < x["long"]) & (y["share"] > x["share"])
        return F.exists("held", lambda y: F.coalesce(F.array_contains(x["rivals"], y["license"]), F.lit(False)) & near(y))

    kept = held.select("id", F.inline(F.filter("held", lambda x: ~beaten(x))))
    return kept.select(F.col("id").alias(key), "license", F.col("at").cast("int").alias("first_word"), F.col("share").alias("containment"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license that a document holds, one row for each."""
    return scan_licenses(table(spark, sf_dir, "documents"))
