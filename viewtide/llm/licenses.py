"""Licence scans: sparse TF-IDF cosine to templates, and inheritance along the directory path.

Every template names one of its words as its anchor. Wherever the anchor occurs in a text, the window of the
template's length that has the anchor at the template's place is a unit, cut off at the ends of the text; so
a notice is found inside a paragraph, across lines and beside a copyright line alike. A unit is compared with its template, a
licence file besides as a whole with all templates. Vectors hold term frequency x inverse document frequency over the
templates; unknown words have the largest weight. A unit takes the template with the largest cosine from ``THRESHOLD`` up.
A document's own licence is its best unit's. A document without one inherits from the nearest directory above it that has a licence file with a
licence. Only DataFrame expressions are used; the templates are a fixed small table.

Defined cases: null and empty texts have no licence of their own. A null path has no directory and inherits
nothing. Of equal scores the template first in order wins (so longer, more specific ones stand first), of several licence files in a directory the
better score, then the first template in order. Rows that repeat a doc_id are judged as rows of their own, null ids too. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.session import stage_table

THRESHOLD = 0.72
# Licence, notice or title by which it is declared, and the notice's anchor word.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("Apache-2.0", "Apache License Version 2.0", "apache"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", "spdx"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause", "spdx"),
    ("BSD-2-Clause", "BSD 2-Clause License", "clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause", "spdx"),
    ("BSD-3-Clause", "BSD 3-Clause License", "clause"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "cc"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creative"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "cc"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "creative"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "cc"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "creative"),
    ("CC-BY-4.0", "CC BY 4.0", "cc"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "creative"),
    ("AGPL-3.0", "GNU Affero General Public License version 3", "affero"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0", "spdx"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1", "lesser"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1", "spdx"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3", "lesser"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0", "spdx"),
    ("LGPL", "GNU Lesser General Public License", "lesser"),
    ("GPL-2.0", "GNU General Public License version 2", "gnu"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0", "spdx"),
    ("GPL-3.0", "GNU General Public License version 3", "gnu"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0", "spdx"),
    ("GPL", "GNU General Public License", "gnu"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("ISC", "SPDX-License-Identifier: ISC", "spdx"),
    ("ISC", "ISC License", "isc"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby"),
    ("MIT", "SPDX-License-Identifier: MIT", "spdx"),
    ("MIT", "MIT License", "license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0", "spdx"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla"),
    ("Proprietary", "All rights reserved", "reserved"),
)
UNITS = "array<struct<score:double,place:int,license:string>>"
_TOKEN = re.compile(r"[a-z0-9]+")


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def template_weights() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Inverse document frequencies, that of unknown words, and each template's unit vector."""
    docs = [Counter(_tokens(t)) for _, t, _ in TEMPLATES]
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in sorted(df.items())}
    vectors = []
    for (name, _, _), d in zip(TEMPLATES, docs, strict=True):
        raw = {w: n * idf[w] for w, n in sorted(d.items())}
        length = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append((name, {w: x / length for w, x in raw.items()}))
    return idf, math.log(1 + len(docs)) + 1, vectors


def anchors() -> list[tuple[int, str, str, int, int]]:
    """Of each template: place (0, -1, -2 and so on), licence, anchor word, words before the anchor, words in all."""
    found = []
    for i, (name, text, word) in enumerate(TEMPLATES):
        tokens = _tokens(text)
        found.append((-i, name, word, tokens.index(word), len(tokens)))
    return found


ANCHORS = sorted({word for _, _, word, _, _ in anchors()})
_HAS_ANCHOR = "(?i)(?:" + "|".join(ANCHORS) + ")"


def _known(words: Column) -> Column:
    return F.filter(words, lambda w: w.isin(sorted(template_weights()[0])))


def _length(words: Column) -> Column:
    """Length of the vector of a unit's sorted words."""
    idf, unknown, _ = template_weights()
    table = F.create_map(*[F.lit(x) for w in sorted(idf) for x in (w, idf[w])])
    weighed = F.transform(words, lambda w: F.struct(w.alias("w"), F.coalesce(F.try_element_at(table, w), F.lit(unknown)).alias("f")))
    start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("squares"))

    def add(at: Column, x: Column) -> Column:
        n = F.when(x["w"] == at["w"], at["n"] + 1).otherwise(1.0)
        # the square of n minus that of n - 1, so that a word adds up to the square of its count
        return F.struct(x["w"].alias("w"), n.alias("n"), (at["squares"] + (2 * n - 1) * x["f"] * x["f"]).alias("squares"))

    return F.aggregate(weighed, start, add, lambda at: F.sqrt(at["squares"]))


def _templates() -> Column:
    """The templates as an array of structs (place, license, anchor, before, words, v)."""
    idf, _, vectors = template_weights()
    return F.array(*[
        F.struct(
            F.lit(place).alias("place"), F.lit(name).alias("license"), F.lit(anchor).alias("anchor"), F.lit(before).alias("before"), F.lit(words).alias("words"),
            F.create_map(*[F.lit(x) for w in sorted(v) for x in (w, idf[w] * v[w])]).alias("v"),
        )
        for (place, name, anchor, before, words), (_, v) in zip(anchors(), vectors, strict=True)
    ])


def _score(known: Column, length: Column, template: Column) -> Column:
    """Struct (score, place, license): the cosine of a unit's sorted words, of which ``known`` are in templates, of that vector length to a template."""
    product = F.aggregate(known, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(template["v"], w), F.lit(0.0)))
    return F.struct(F.round(product / length, 9).alias("score"), template["place"].alias("place"), template["license"].alias("license"))


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path and the struct best (score, place, license) of every file, null without a licence of its own.

    Each file is judged within its row, so no text moves. Texts without any anchor word are not split.
    """
    named = F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^(licen[cs]e|copying|notice)(\.|$)")
    able = files.select("doc_id", "path", F.when(F.col("text").rlike(_HAS_ANCHOR), F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")).alias("words"))
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(ANCHORS), F.struct(w.alias("w"), i.alias("i")))))

    def window(template: Column, at: Column) -> Column:
        start = at - template["before"]
        cut = F.greatest(start, F.lit(0))
        return F.sort_array(F.slice("words", cut + 1, template["words"] - (cut - start)))

    def units(hit: Column) -> Column:
        cut = F.transform(F.filter(_templates(), lambda t: t["anchor"] == hit["w"]), lambda t: F.struct(t.alias("t"), window(t, hit["i"]).alias("words")))
        return F.transform(cut, lambda u: _score(_known(u["words"]), _length(u["words"]), u["t"]))

    placed = able.withColumn("hits", hits)
    whole = F.when(named & (F.size("words") > 0), F.sort_array("words"))
    scored = placed.select("doc_id", "path", F.flatten(F.transform("hits", units)).alias("units"), whole.alias("whole"))
    # the outer function holds both values for all templates; as columns the planner would put them into the inner one
    once = F.array(F.struct(_known(F.col("whole")).alias("known"), _length(F.col("whole")).alias("length")))
    files_too = F.when(F.col("whole").isNotNull(), F.flatten(F.transform(once, lambda u: F.transform(_templates(), lambda t: _score(u["known"], u["length"], t)))))
    both = F.concat(F.coalesce("units", F.array().cast(UNITS)), F.coalesce(files_too, F.array().cast(UNITS)))
    best = scored.select("doc_id", "path", F.array_max(both).alias("best"))
    return best.select("doc_id", "path", F.when(F.col("best.score") >= threshold, F.col("best")).alias("best"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, how (own, inherited or none), license_dir for files (doc_id, path, text).

    The files' own licences are written once to the shared folder and read for the directories and for the rows.
    """
    own = stage_table(own_licenses(files, threshold), "own-licenses")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    named = F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^(licen[cs]e|copying|notice)(\.|$)")
    licensed = own.where(named & F.col("best").isNotNull()).select(folder.alias("dir"), "best").groupBy("dir").agg(F.max("best").alias("dir_best"))
    dirs = own.where("path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select(F.col("dir").alias("at"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir"))
    nearest = above.join(licensed, "dir").groupBy("at").agg(F.max_by(F.struct("dir_best", "dir"), F.length("dir")).alias("from"))
    rows = own.withColumn("at", folder).join(nearest, "at", "left")
    mine = F.col("best").isNotNull()
    given = F.coalesce("best", "from.dir_best")
    how = F.when(mine, "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return rows.select("doc_id", "path", given["license"].alias("license"), F.round(given["score"], 6).alias("score"), how.alias("how"), F.when(~mine, F.col("from.dir")).alias("license_dir"))


def filed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` placed in a tree of files, as the table carries no paths: source / lang / group / folder / name.

    A folder holds the documents of 80 consecutive doc_ids with the same source and language, a group
    those of 640. A quarter of the documents are licence files of their group, a quarter of their folder.
    """
    i = F.col("doc_id")
    spot = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("g"), F.floor(i / 640)))
    inner = F.concat_ws("/", spot, F.concat(F.lit("f"), F.floor(i / 80)))
    name = F.concat(F.lit("doc"), i, F.lit(".txt"))
    path = F.when(i % 4 == 0, F.concat_ws("/", spot, F.lit("LICENSE"))).when(i % 4 == 1, F.concat_ws("/", inner, F.lit("LICENSE"))).otherwise(F.concat_ws("/", inner, name))
    return docs.select("doc_id", path.alias("path"), "text")


def _oracle() -> str:
    """DuckDB SQL of ``scan(filed_documents(documents))``, written out from the templates."""
    idf, unknown, vectors = template_weights()
    values = lambda rows: ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else f"'{x}'" for x in r) + ")" for r in rows)
    return rf"""
WITH idf(w, f) AS (VALUES {values(list(idf.items()))}),
vec(place, license, w, v) AS (VALUES {values([(-i, n, w, x) for i, (n, v) in enumerate(vectors) for w, x in v.items()])}),
temps(place, license, anchor, k, n) AS (VALUES {values(anchors())}),
spots AS (SELECT *, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), 'g' || CAST(doc_id // 640 AS VARCHAR)) AS spot FROM documents),
files AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN spot || '/LICENSE' WHEN doc_id % 4 = 1 THEN spot || '/f' || CAST(doc_id // 80 AS VARCHAR) || '/LICENSE'
  ELSE spot || '/f' || CAST(doc_id // 80 AS VARCHAR) || '/doc' || CAST(doc_id AS VARCHAR) || '.txt' END AS path FROM spots),
dirs AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path LIKE '%/LICENSE' AS named FROM files),
split AS (SELECT doc_id, path, named, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM files JOIN dirs USING (doc_id, path) WHERE regexp_matches(text, '{_HAS_ANCHOR}')),
hits AS (SELECT doc_id, path, unnest(list_filter(range(1, len(ws) + 1), lambda i: list_contains([{", ".join(f"'{w}'" for w in ANCHORS)}], ws[i]))) AS i FROM split),
units AS (SELECT row_number() OVER () AS u, * FROM (
  SELECT doc_id, path, t.place AS aim, list_slice(ws, greatest(1, i - k), i - k + n - 1) AS unit FROM hits JOIN split USING (doc_id, path) JOIN temps t ON ws[i] = t.anchor
  UNION ALL SELECT doc_id, path, NULL, ws FROM split WHERE named)),
terms AS (SELECT u, w, count(*) AS n FROM (SELECT u, unnest(unit) AS w FROM units) GROUP BY u, w),
weighed AS (SELECT t.u, t.w, t.n * coalesce(CAST(i.f AS DOUBLE), CAST({unknown!r} AS DOUBLE)) AS x FROM terms t LEFT JOIN idf i USING (w)),
lengths AS (SELECT u, sqrt(sum(x * x)) AS len FROM weighed GROUP BY u),
scored AS (SELECT w.u, v.place, v.license, round(sum(w.x * CAST(v.v AS DOUBLE)) / any_value(l.len), 9) AS score FROM weighed w JOIN vec v USING (w) JOIN lengths l USING (u) GROUP BY w.u, v.place, v.license),
own AS (SELECT doc_id, path, max({{'score': score, 'place': place, 'license': license}}) AS best FROM scored JOIN units USING (u) WHERE score >= {THRESHOLD} AND coalesce(aim = place, true) GROUP BY doc_id, path),
licensed AS (SELECT dir, max(best) AS best FROM own JOIN dirs USING (doc_id, path) WHERE named GROUP BY dir),
above AS (SELECT base, array_to_string(list_slice(string_split(base, '/'), 1, k), '/') AS dir FROM (SELECT base, unnest(range(1, len(string_split(base, '/')) + 1)) AS k FROM (SELECT DISTINCT dir AS base FROM dirs))),
nearest AS (SELECT base, arg_max(l.best, length(a.dir)) AS best, arg_max(a.dir, length(a.dir)) AS dir FROM above a JOIN licensed l ON a.dir = l.dir GROUP BY base)
SELECT d.doc_id, d.path, coalesce(o.best, n.best).license AS license, round(coalesce(o.best, n.best).score, 6) AS score,
  CASE WHEN o.best IS NOT NULL THEN 'own' WHEN n.best IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, CASE WHEN o.best IS NULL THEN n.dir END AS license_dir
FROM dirs d LEFT JOIN own o ON d.doc_id = o.doc_id AND d.path = o.path LEFT JOIN nearest n ON n.base = d.dir
"""


SQL = _oracle()
