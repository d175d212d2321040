"""Licence scans: sparse TF-IDF cosine of notices to templates, then inheritance
from the nearest ancestor directory.

A file's header notices are its lines that hold a licence cue, and the blocks from
the first to the last of such lines no more than BLOCK_GAP apart; each becomes a
TF-IDF vector of its words and is compared with every template by cosine. A file
whose whole text, of any length, is that close to a template is a licence file and
speaks for its directory. Templates are one-line notices, and the full texts and
standard headers in the folder `licenses`. The latter are weighed among themselves,
where a word that all of them have weighs nothing. A file without a notice of its own takes the licence of the
nearest directory above it that has a licence file. Words outside the templates
count in a vector's length with the weight of an unseen word.

Templates and the word weights from them are a parameter of bounded size and are
broadcast; everything else stays distributed. Ancestors are found by joining
each file's directory prefixes, one row each, with licensed directories.

Results in special cases: null and empty texts have no notice and inherit; a
null path has no directory and can only have its own notice; of several notices
(or licence files of a directory) the closest wins, then the template first in
code points, then the smallest path; repeated rows get a row each; other
columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

THRESHOLD = 0.6
CUE = r"(?i)licen[cs]e|copying|redistribut|warrant|permission is|public domain|spdx"
#: Lines between two cue lines of one header block, at most, plus one.
BLOCK_GAP = 10
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"

#: Short notices that name a licence: the templates.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Released under the 3-clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This file is subject to the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}

def _words(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


@lru_cache(maxsize=1)
def full_texts() -> dict[str, tuple[str, ...]]:
    """Full licence texts and standard headers, from the files LICENCE[.header].txt."""
    found: dict[str, tuple[str, ...]] = {}
    for file in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
        name = file.name.removesuffix(".txt").removesuffix(".header")
        found[name] = (*found.get(name, ()), file.read_text(encoding="utf-8"))
    return found


def template_vectors(templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 1) -> tuple[list[tuple[str, int, str, float, float]], float]:
    """(licence, template, word, weight in a text, unit weight) rows and the
    weight of an unseen word; least is the weight of a word in all templates."""
    notices = [(name, i, Counter(_words(text))) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    seen = Counter(w for _, _, words in notices for w in words)
    idf = {w: math.log((len(notices) + 1) / (n + 1)) + least for w, n in seen.items()}
    rows = []
    for name, i, words in notices:
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in words.items()))
        rows += [(name, i, w, idf[w], n * idf[w] / length) for w, n in sorted(words.items())]
    return rows, math.log(len(notices) + 1) + least


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def closest_templates(spark: SparkSession, notices: DataFrame, vectors: list[tuple[list[tuple[str, int, str, float, float]], float]]) -> DataFrame:
    """notices(id, part, words) with the closest licence and its cosine, for
    those of THRESHOLD or more, over all sets of template vectors."""
    counted = notices.select("id", "part", F.explode("words").alias("word")).groupBy("id", "part", "word").agg(F.count("*").alias("n"))
    near = None
    for rows, unseen in vectors:
        terms = F.broadcast(spark.createDataFrame(rows, "license string, template int, word string, idf double, unit double").filter("unit > 0"))
        idf = F.broadcast(spark.createDataFrame(sorted({(w, x) for _, _, w, x, _ in rows}), "word string, idf double"))
        weighed = counted.join(idf, "word", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(unseen)))
        length = weighed.groupBy("id", "part").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
        inner = weighed.select("id", "part", "word", "x").join(terms.drop("idf"), "word").groupBy("id", "part", "license", "template").agg(F.sum(F.col("x") * F.col("unit")).alias("inner"))
        found = inner.join(length.filter("length > 0"), ["id", "part"]).withColumn("similarity", F.round(F.col("inner") / F.col("length"), 9)).filter(F.col("similarity") >= THRESHOLD)
        near = found if near is None else near.union(found)
    best = F.min_by("license", F.struct(-F.col("similarity"), "license"))
    return near.groupBy("id", "part").agg(best.alias("license"), F.max("similarity").alias("similarity"))


def _directories(path: Column) -> Column:
    """All directories above a path, the root '' included, with their depth."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("dir")))


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """files(path, text, ...) without text, with license, similarity, origin
    ('file', 'header', 'inherited' or 'none') and license_dir (where an inherited
    one is from); these four replace columns of their names.
    texts are full texts and headers of licences, full_texts() if not given."""
    spark = files.sparkSession
    # texts with a cue, once per distinct (path, text); whole rows never travel
    keyed = files.withColumns({"__lf_id": F.xxhash64("path", "text")})
    cued = keyed.filter(F.col("text").rlike(CUE)).select(F.col("__lf_id").alias("id"), "path", "text").dropDuplicates(["id"])
    at = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.when(line.rlike(CUE), i)), lambda i: i.isNotNull())
    cued = settle(cued.select("id", "path", F.split("text", "\n").alias("lines"), at.alias("at")))
    headers = cued.select("id", F.posexplode(F.transform("at", lambda i: _tokens(F.get("lines", i)))).alias("part", "words"))
    wholes = cued.select("id", F.lit(-1).alias("part"), _tokens(F.array_join("lines", "\n")).alias("words"))
    # a block starts at a cue line far below the one before it, and ends at one far above the next
    starts = F.filter("at", lambda x, i: (i == 0) | (x - F.get("at", i - 1) > BLOCK_GAP))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - x > BLOCK_GAP))
    bounds = cued.select("id", "lines", F.posexplode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("n", "block")).filter("block.b > block.a")
    block = F.slice("lines", F.col("block.a") + 1, F.col("block.b") - F.col("block.a") + 1)
    blocks = bounds.select("id", (-2 - F.col("n")).alias("part"), _tokens(F.array_join(block, "\n")).alias("words"))
    vectors = [template_vectors(templates), template_vectors(full_texts() if texts is None else texts, 0)]
    found = closest_templates(spark, headers.union(wholes).union(blocks), vectors)
    ranked = F.struct((F.col("part") == -1).alias("whole"), "similarity", (-F.col("part")).alias("early"))
    own = settle(found.groupBy("id").agg(F.max_by(F.struct("license", "similarity", (F.col("part") == -1).alias("whole")), ranked).alias("own")))
    is_file = own.filter("own.whole").join(cued.select("id", "path"), "id").filter("path is not null")
    speaks = is_file.withColumn("dir", F.element_at(_directories(F.col("path")), -1)["dir"])
    licensed = speaks.groupBy("dir").agg(F.min_by("own", F.struct((-F.col("own.similarity")).alias("s"), "own.license", "path")).alias("theirs"))
    # directories, not files, look for their nearest licensed ancestor
    keyed = keyed.withColumn("__lf_dir", F.element_at(_directories(F.col("path")), -1)["dir"])
    above = keyed.filter("__lf_dir is not null").select("__lf_dir").distinct().withColumn("up", F.explode(_directories(F.concat("__lf_dir", F.when(F.col("__lf_dir") == "", F.lit("")).otherwise(F.lit("/"))))))
    nearest = above.select("__lf_dir", F.col("up.depth").alias("depth"), F.col("up.dir").alias("dir")).join(licensed, "dir").groupBy("__lf_dir").agg(F.max_by(F.struct("dir", "theirs"), "depth").alias("near"))
    own, nearest = own.select(F.col("id").alias("__lf_id"), F.col("own").alias("__lf_own")), nearest.withColumnRenamed("near", "__lf_near")
    added = {
        "license": lambda has: F.when(has, F.col("__lf_own.license")).otherwise(F.col("__lf_near.theirs.license")),
        "similarity": lambda has: F.when(has, F.col("__lf_own.similarity")).otherwise(F.col("__lf_near.theirs.similarity")),
        "origin": lambda has: F.when(has & F.col("__lf_own.whole"), "file").when(has, "header").when(F.col("__lf_near").isNotNull(), "inherited").otherwise("none"),
        "license_dir": lambda has: F.when(~has, F.col("__lf_near.dir")),
    }
    kept = [c for c in files.columns if c not in added and c != "text"]
    joined = keyed.select(*kept, "__lf_id", "__lf_dir").join(own, "__lf_id", "left").join(nearest, "__lf_dir", "left")
    return joined.select(*kept, *(make(F.col("__lf_own").isNotNull()).alias(name) for name, make in added.items()))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id.txt."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", "doc_id")]
    return docs.select("doc_id", F.concat(part[0], F.lit("/"), part[1], F.lit("/"), part[2], F.lit(".txt")).alias("path"), "text")


def oracle_sql() -> str:
    """DuckDB SQL for the scan of documents. It holds all template texts and
    derives their words and weights itself."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    sets = ((1, TEMPLATES), (0, full_texts()))
    values = ", ".join(f"({least}, {quoted(name)}, {i}, {quoted(text)})" for least, templates in sets for name, texts in sorted(templates.items()) for i, text in enumerate(texts))
    return f"""
WITH given(least, license, template, text) AS (VALUES {values}),
tw AS (SELECT least, license, template, word, count(*) AS n
       FROM (SELECT least, license, template, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS word FROM given) GROUP BY ALL),
sets AS (SELECT least, count(*) AS templates, ln(count(*) + 1) + least AS unseen FROM given GROUP BY least),
idf AS (SELECT least, word, ln((any_value(templates) + 1) / (count(*) + 1)) + least AS idf FROM tw JOIN sets USING (least) GROUP BY least, word),
t AS (SELECT least, license, template, word, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY least, license, template)) AS unit FROM tw JOIN idf USING (least, word)),
f AS (SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') AS dir,
             coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') || '.txt' AS path, text FROM documents),
cued AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM f WHERE regexp_matches(text, '{CUE}')),
cues AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS part, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap
         FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM cued) WHERE regexp_matches(line, '{CUE}')),
grouped AS (SELECT *, sum(CASE WHEN gap > {BLOCK_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM cues),
spans AS (SELECT doc_id, block, min(i) AS a, max(i) AS b FROM grouped GROUP BY ALL HAVING max(i) > min(i)),
spanned AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS n, a, b FROM spans),
parts AS (SELECT doc_id, part, line FROM cues UNION ALL SELECT doc_id, -1, text FROM cued
          UNION ALL SELECT doc_id, -2 - n, array_to_string(lines[a:b], chr(10)) FROM spanned JOIN cued USING (doc_id)),
counted AS (SELECT doc_id, part, word, count(*) AS n FROM (SELECT doc_id, part, unnest(regexp_extract_all(lower(line), '{_TOKEN}')) AS word FROM parts) GROUP BY ALL),
x AS (SELECT c.*, s.least, n * coalesce(i.idf, s.unseen) AS x FROM counted c CROSS JOIN sets s LEFT JOIN idf i ON i.least = s.least AND i.word = c.word),
lengths AS (SELECT doc_id, part, least, sqrt(sum(x * x)) AS length FROM x GROUP BY ALL HAVING length > 0),
near AS (SELECT doc_id, part, license, round(sum(x * unit) / any_value(length), 9) AS similarity FROM x JOIN t USING (least, word) JOIN lengths USING (doc_id, part, least)
         WHERE unit > 0 GROUP BY doc_id, part, least, license, template HAVING similarity >= {THRESHOLD}),
own AS (SELECT doc_id, license, similarity, part = -1 AS whole FROM near
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY part <> -1, similarity DESC, part, license) = 1),
speaks AS (SELECT dir, license, similarity FROM own JOIN f USING (doc_id) WHERE whole
           QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license, path) = 1),
up AS (SELECT DISTINCT dir, unnest([dir, split_part(dir, '/', 1), '']) AS above, unnest([2, 1, 0]) AS depth FROM f),
heirs AS (SELECT up.dir, above, license, similarity FROM up JOIN speaks ON speaks.dir = above
          QUALIFY row_number() OVER (PARTITION BY up.dir ORDER BY depth DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.license, h.license) AS license, coalesce(own.similarity, h.similarity) AS similarity,
       CASE WHEN own.whole THEN 'file' WHEN own.license IS NOT NULL THEN 'header' WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.license IS NULL THEN h.above END AS license_dir
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN heirs h ON h.dir = f.dir
"""
