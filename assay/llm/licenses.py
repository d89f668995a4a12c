"""Licence scan: TF-IDF cosine to templates, then directory inheritance.

Method, in DataFrame functions only:

1. templates (identifiers, titles, notices, whole short licences) become sparse
   TF-IDF vectors of unit length;
2. each template's anchors are its words less those most frequent in the files,
   as many of these as keep less than ``threshold`` of its length. A passage
   without an anchor has a smaller cosine than that (Cauchy-Schwarz);
3. whole texts are scanned for anchors; each occurrence lays the template over
   the text so that the anchor's places agree. These are the passages: of the
   template's number of words, with an anchor at its own place. (A header whose
   words stand in another order has a passage only where an anchor has kept its
   place.) They are compared as TF-IDF vectors, every distinct passage once,
   however many files have it;
4. passages of at least ``threshold`` that hold the template's decisive words
   name a licence; a file's own licence is the one with the most matched words
   (cosine times words). A licence file gives its licence to its directory
   (most matched words, then smallest id). A file without a licence of its own
   inherits from the nearest ancestor directory that has one, by a join of path
   prefixes. A path without a slash lies in the relative root ".", which is the
   topmost ancestor of all relative paths; that of absolute ones is "".

Work is linear in the texts. Rows are known by a hash of id, path and text.
Templates are a fixed list and therefore broadcast. Other small sides are
broadcast up to a counted limit and joined beyond it.

Defined results: a null or empty text has no licence of its own; a null path
has no directory and inherits nothing; ties go to the licence's name in
alphabetical order; repeated rows are judged one by one and alike; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, stored

#: Licence, words that a passage must hold, and text.
TEMPLATES = [
    ("Apache-2.0", "apache 2", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "unless conditions", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "bsd 2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "redistributions disclaimer", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "bsd 3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "redistributions neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC0-1.0", "cc0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "epl 2", "SPDX-License-Identifier: EPL-2.0"),
    ("EPL-2.0", "eclipse 2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "gpl 2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "gpl 2", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "general 2", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gpl 3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "gpl 3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "general 3", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "general 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "agpl 3", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "agpl 3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("AGPL-3.0", "affero 3", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "affero 3", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "lgpl 2 1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-2.1", "lesser 2 1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "lesser 2 1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "lgpl 3", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "lesser 3", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "lesser 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "isc", "SPDX-License-Identifier: ISC"),
    ("ISC", "isc", "Released under the ISC License."),
    ("ISC", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "mit", "SPDX-License-Identifier: MIT"),
    ("MIT", "mit", "The MIT License (MIT)"),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "mpl 2", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "mozilla 2", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("Unlicense", "unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "all rights reserved", "All rights reserved."),
]
#: Code and name of the attribution licences, which come in three wordings each.
CREATIVE_COMMONS = [
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
WORDINGS = [("cc {0} 4", "SPDX-License-Identifier: CC-{0}-4.0"), ("cc {0} 4", "Licensed under CC {0} 4.0."), ("commons {1} 4", "This work is licensed under a Creative Commons {1} 4.0 International License.")]
#: Rows (of about 200 bytes) that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Slack for rounding where a cosine meets the threshold.
EPSILON = 1e-9


def counted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def all_templates() -> list[tuple[str, str, str]]:
    commons = [(f"CC-{code}-4.0", must.format(code, name), text.format(code, name)) for code, name in CREATIVE_COMMONS for must, text in WORDINGS]
    return TEMPLATES + commons


def tokens(text: Column | str) -> Column:
    return F.array_remove(F.split(lower_ascii(text), r"[^a-z0-9]+"), "")


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, must, words, n)."""
    rows = [F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(must).alias("must"), F.lit(text).alias("text")) for k, (name, must, text) in enumerate(all_templates())]
    table = spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))
    words = tokens("text")
    return table.select("template", "license", tokens("must").alias("must"), words.alias("words"), F.size(words).alias("n"))


def inverse_frequencies(own: DataFrame) -> tuple[DataFrame, float]:
    """(word, idf) over the templates, and the idf of any other word."""
    count = len(all_templates())
    spread = own.select("template", F.explode("words").alias("word")).groupBy("word").agg(F.countDistinct("template").alias("df"))
    return spread.select("word", (F.ln((1 + count) / (1 + F.col("df"))) + 1).alias("idf")), math.log(1 + count) + 1


def template_weights(own: DataFrame, idf: DataFrame) -> DataFrame:
    """(template, word, weight): TF-IDF vectors of unit length."""
    raw = own.select("template", F.explode("words").alias("word")).groupBy("template", "word").agg(F.count("*").alias("tf")).join(idf, "word")
    raw = raw.withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("template")))
    return raw.select("template", "word", (F.col("raw") / norm).alias("weight"))


def anchors(own: DataFrame, weights: DataFrame, frequencies: DataFrame, threshold: float) -> DataFrame:
    """(word, template, offset, n): what a passage must hold one of to reach the threshold."""
    rated = weights.join(frequencies, "word", "left")
    by_frequency = Window.partitionBy("template").orderBy(F.desc(F.coalesce("frequency", F.lit(0))), "word")
    left_out = F.sum(F.col("weight") * F.col("weight")).over(by_frequency)
    kept = rated.withColumn("left_out", left_out).where(F.col("left_out") >= threshold * threshold - EPSILON).select("template", "word")
    places = own.select("template", "n", F.posexplode("words").alias("offset", "word"))
    return places.join(kept, ["template", "word"]).select("word", "template", "offset", "n")


def passages(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, template, start, n, passage) where anchors lay a template over a text; (key, words) rows."""
    starts = found.groupBy("key").agg(F.collect_set(F.struct("template", "start", "n")).alias("starts"))
    texts = rows.join(counted(starts.select("key")), "key", "left_semi").select("key", tokens("text").alias("w")).dropDuplicates(["key"])
    cut = F.transform("starts", lambda c: F.struct(c["template"].alias("template"), c["start"].alias("start"), F.slice("w", c["start"] + 1, c["n"]).alias("passage")))
    return texts.join(starts, "key").select("key", F.size("w").alias("words"), F.inline(cut))


def cosines(distinct: DataFrame, weights: DataFrame, idf: DataFrame, unseen: float) -> DataFrame:
    """(print, template, score) of distinct (print, template, passage)."""
    tf = distinct.select("print", "template", F.explode("passage").alias("word")).groupBy("print", "template", "word").agg(F.count("*").alias("tf"))
    raw = tf.join(F.broadcast(idf), "word", "left").join(F.broadcast(weights), ["template", "word"], "left")
    raw = raw.withColumn("raw", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    score = F.sum(F.col("raw") * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(F.col("raw") * F.col("raw")))
    return raw.groupBy("print", "template").agg(score.alias("score"))


def own_licenses(rows: DataFrame, threshold: float) -> DataFrame:
    """(key, own_license, score, matched, share) of (key, text) rows with a licence."""
    own = stored(templates(rows.sparkSession), "license-templates")
    idf, unseen = inverse_frequencies(own)
    weights = stored(template_weights(own, idf), "license-weights")
    places = rows.select("key", F.posexplode(tokens("text")).alias("place", "word"))
    frequencies = places.join(F.broadcast(idf.select("word")), "word", "left_semi").groupBy("word").agg(F.count("*").alias("frequency"))
    laid = stored(anchors(own, weights, stored(frequencies, "license-words"), threshold), "license-anchors")
    found = places.join(F.broadcast(laid), "word").select("key", "template", F.greatest(F.col("place") - F.col("offset"), F.lit(0)).alias("start"), "n").distinct()
    seen = passages(rows, stored(found, "license-places")).withColumn("print", F.xxhash64("passage"))
    seen = stored(seen.join(F.broadcast(own.select("template", "must")), "template").where(F.size(F.array_except("must", "passage")) == 0).drop("must"), "license-passages")
    scores = stored(cosines(seen.select("print", "template", "passage").dropDuplicates(["print", "template"]), weights, idf, unseen).where(F.col("score") >= threshold), "license-scores")
    hits = seen.join(counted(scores), ["print", "template"]).join(F.broadcast(own.select("template", "license")), "template")
    hits = hits.withColumns({"matched": F.round(F.col("score") * F.size("passage"), 6), "score": F.round("score", 9)})
    best = F.min_by(F.struct("license", "score", "matched"), F.struct(-F.col("matched"), -F.col("score"), F.col("license"))).alias("best")
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.size("passage") - 1)))))
    out = hits.groupBy("key").agg(best, (covered / F.max("words")).alias("share"))
    return out.select("key", F.col("best.license").alias("own_license"), F.col("best.score").alias("score"), F.col("best.matched").alias("matched"), "share")


def parent(path: Column | str) -> Column:
    """The directory of a path: "." for one without a slash, "" for one below the absolute root only."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(F.col(path).isNotNull() if isinstance(path, str) else path.isNotNull(), "."))


def nearest_given(dirs: DataFrame, given: DataFrame) -> DataFrame:
    """(dir, near): of each of ``dirs`` the nearest directory upwards in ``given``, itself included."""
    depth = F.explode(F.sequence(F.lit(0), F.size(F.split("dir", "/")))).alias("depth")
    relative = ~(F.startswith("dir", F.lit("/")) | (F.col("dir") == ""))
    above = dirs.select("dir", F.split("dir", "/").alias("steps"), depth).where((F.col("depth") > 0) | relative)
    above = above.select("dir", "depth", F.when(F.col("depth") > 0, F.array_join(F.slice("steps", 1, F.col("depth")), "/")).otherwise(".").alias("license_dir"))
    near = above.join(counted(given.withColumnRenamed("dir", "license_dir")), "license_dir")
    return near.groupBy("dir").agg(F.max_by(F.struct("license_dir", "dir_license"), "depth").alias("near"))


def scan(
    files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", file_share: float = 0.5, threshold: float = 0.7
) -> DataFrame:
    """Return (id_col, path, own_license, score, license, license_dir).

    A licence file is one named LICENSE, LICENCE, COPYING or NOTICE, or one in
    which licence passages hold at least ``file_share`` of all words.
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.xxhash64(id_col, path_col, text_col).alias("key"))
    own = stored(own_licenses(rows, threshold), "license-own")
    bare = rows.select("id", "path", parent("path").alias("dir"), "key").join(counted(own), "key", "left")
    bare = stored(bare, "license-files")
    named = F.coalesce(F.col("path").rlike(r"(?i)(^|/)(LICEN[SC]E|COPYING|NOTICE)[^/]*$"), F.lit(False))
    given = bare.where(F.col("own_license").isNotNull() & (named | (F.col("share") >= file_share)) & F.col("dir").isNotNull())
    given = given.groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("matched"), F.col("id"))).alias("dir_license"))
    near = stored(nearest_given(bare.select("dir").where("dir is not null").distinct(), stored(given, "license-given")), "license-dirs")
    out = bare.join(counted(near), "dir", "left")
    return out.select(
        F.col("id").alias(id_col), "path", "own_license", "score",
        F.coalesce("own_license", "near.dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.license_dir")).alias("license_dir"),
    )
