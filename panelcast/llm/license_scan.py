"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a text are hashed (three words; two for base
phrases of two words) and those that occur in a license template are joined
to their template positions. A match votes for the diagonal ``text position -
template position``; consecutive votes of a diagonal are a run, and a run
that holds all of a base phrase is a place where it stands word for word.

Runs of a template are chained along the text: the next run of a chain lies
further on in the template and on the same or a neighbouring diagonal (up to
``GAP`` words inserted or left out); a run inside a longer one is no link. A
chain is verified on the words: it must hold ``MIN_COVER`` of the template's
words, in the template's order, within the template's length and ``STRETCH``
of it (and ``GAP`` words) more.

Texts are read once, in a row-wise pass that writes a narrow table: word
count and the few matching grams of each row. Everything that is joined and
grouped is made from that table. The template table is a parameter of some
hundred grams, so its broadcast and the hash list in the first pass are
bounded by the parameter and not by the data.

Defined cases: null or empty text has no words and score 0; repeated rows and
null or repeated ids are rows of their own; of runs that start together the
longest comes first; very long texts are scanned whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import pinned, text_of
from panelcast.session import materialize

#: What separates words, after lower-casing.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# The usual notices, in words, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("cc by 4 0", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
)
# Whole notices of common licenses, and their labels.
WHOLE = (
    ("""permission is hereby granted, free of charge, to any person obtaining a copy of this software and
    associated documentation files (the "software"), to deal in the software without restriction, including
    without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the software, and to permit persons to whom the software is furnished to do so, subject to the
    following conditions: the above copyright notice and this permission notice shall be included in all copies
    or substantial portions of the software.""", "mit"),
    ("""permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
    hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
     "isc"),
    ("""redistribution and use in source and binary forms, with or without modification, are permitted provided
    that the following conditions are met: 1. redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce
    the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
    other materials provided with the distribution.""", "bsd"),
    ("""licensed under the apache license, version 2.0 (the "license"); you may not use this file except in
    compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0
    unless required by applicable law or agreed to in writing, software distributed under the license is
    distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied.""",
     "apache"),
    ("""this program is free software: you can redistribute it and/or modify it under the terms of the gnu general
    public license as published by the free software foundation, either version 3 of the license, or (at your
    option) any later version.""", "gpl"),
    ("""this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl
    was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/.""", "mpl"),
)
#: Words of a gram (fewer for shorter templates).
GRAM = 3
GAP = 3
STRETCH = 0.2
MIN_COVER = 0.7


def word_list(phrase: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, phrase.lower()) if w]


def gram_rows(base=BASE, notices=(*NOTICES, *WHOLE)) -> list[tuple]:
    """(template, label, is_base, words, size, tpos, gram) of every gram of every template."""
    rows = []
    for t, (phrase, label) in enumerate((*base, *notices)):
        w = word_list(phrase)
        size = min(GRAM, len(w))
        rows += [(t, label, t < len(base), len(w), size, i, " ".join(w[i:i + size])) for i in range(len(w) - size + 1)]
    return rows


def template_grams(spark: SparkSession, base=BASE, notices=(*NOTICES, *WHOLE)) -> DataFrame:
    return (spark.createDataFrame(gram_rows(base, notices), "template int, label string, is_base boolean, words int, "
                                                            "size int, tpos int, gram string")
            .withColumn("h", F.xxhash64("gram")))


def seeds(docs: DataFrame, hashes: dict[int, list[int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_words, hits) with hits = (pos, size, gram) of the grams in ``hashes``
    (by size); written once."""
    w = F.col("w")

    def found(size: int, known: list[int]) -> Column:
        def gram(i: Column) -> Column:
            return F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)])

        at = F.filter(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(gram(i)).isin(known))
        hits = F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), gram(i).alias("gram")))
        return F.when(F.size(w) >= size, hits).otherwise(F.array().cast("array<struct<pos:int,size:int,gram:string>>"))

    d = (docs.select(F.col(f"`{key}`").alias("key"), pinned(F.array_remove(
            F.split(F.lower(text_of(text)), NOT_WORD), "")).alias("w"))
         .select("key", F.size("w").cast("long").alias("n_words"),
                 F.concat(*[found(size, known) for size, known in sorted(hashes.items())]).alias("hits")))
    return materialize(d.withColumn("row", F.monotonically_increasing_id()), "license-seeds")


def votes(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, template, ..., diagonal, tpos): one verified vote per matching gram."""
    hit = found.select("row", F.explode("hits").alias("x")).select("row", "x.pos", "x.gram")
    t = F.broadcast(templates.drop("h"))  # a parameter of some hundred rows
    return hit.join(t, "gram").select("row", "template", "label", "is_base", "words", "size", "tpos",
                                      (F.col("pos") - F.col("tpos")).alias("diagonal"))


def runs(v: DataFrame) -> DataFrame:
    """(row, template, ..., diagonal, t0, t1): consecutive votes of a diagonal, first and last gram."""
    by = Window.partitionBy("row", "template", "diagonal").orderBy("tpos")
    new = F.coalesce(F.col("tpos") - F.lag("tpos").over(by) > 1, F.lit(True)).cast("int")
    lines = v.withColumn("new", new).withColumn("run", F.sum("new").over(by))
    return (lines.groupBy("row", "template", "label", "is_base", "words", "size", "diagonal", "run")
            .agg(F.min("tpos").alias("t0"), F.max("tpos").alias("t1")).drop("run"))


def places(r: DataFrame) -> DataFrame:
    """(row, label, diagonal) of the base phrases that stand word for word."""
    whole = (F.col("t0") == 0) & (F.col("t1") == F.col("words") - F.col("size"))
    return r.where(F.col("is_base") & whole).select("row", "label", "diagonal")


def spans(r: DataFrame, gap: int = GAP, stretch: float = STRETCH) -> DataFrame:
    """(row, template, label, start, end, cover): chains of runs that keep to order and length.

    A text's runs of one template are at most its words.
    """
    start, end = F.col("diagonal") + F.col("t0"), F.col("diagonal") + F.col("t1") + F.col("size")
    by = Window.partitionBy("row", "template").orderBy("start", F.desc("end"), "t0")
    r = r.withColumns({"start": start, "end": end})
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("inside", F.coalesce(F.col("end") <= reach, F.lit(False))).where(~F.col("inside"))
    t1, diagonal = F.lag("t1").over(by), F.lag("diagonal").over(by)
    linked = (F.col("t0") > t1) & (F.abs(F.col("diagonal") - diagonal) <= gap)
    r = r.withColumns({"new": (~F.coalesce(linked, F.lit(False))).cast("int"), "before": t1})
    r = r.withColumn("chain", F.sum("new").over(by))
    # Words of the template that this run adds to its chain.
    own = F.col("t1") + F.col("size") - F.when(F.col("new") == 1, F.col("t0")).otherwise(
        F.greatest(F.col("t0"), F.col("before") + F.col("size")))
    return (r.withColumn("own", own).groupBy("row", "template", "label", "words", "chain")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("own").alias("n"))
            .where(F.col("end") - F.col("start") <= F.col("words") * (1 + stretch) + gap)
            .select("row", "template", "label", "start", "end", (F.col("n") / F.col("words")).alias("cover")))


def scan(docs: DataFrame, base=BASE, notices=(*NOTICES, *WHOLE), key: str = "doc_id", text: str = "text"):
    """(seeds, places, spans) of ``docs``; spans are those that pass the check."""
    templates = template_grams(docs.sparkSession, base, notices)
    hashes: dict[int, list[int]] = {}
    for r in templates.select("size", "h").distinct().collect():  # bounded by the templates
        hashes.setdefault(r["size"], []).append(r.h)
    found = seeds(docs, hashes, key, text)
    r = runs(votes(found, templates))
    return found, places(r), spans(r).where(F.col("cover") >= MIN_COVER)


def _sorted(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(labels)), ",")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: words, base places, labels of both kinds, and the best cover."""
    found, exact, merged = scan(docs)
    base = exact.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"), _sorted(F.col("label")).alias("base_labels"))
    either = (merged.select("row", "label", "cover")
              .unionByName(exact.select("row", "label", F.lit(1.0).alias("cover")))
              .groupBy("row").agg(_sorted(F.col("label")).alias("labels"), F.max("cover").alias("score")))
    return (found.select("row", F.col("key").alias("doc_id"), "n_words").join(base, "row", "left").join(either, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
                    "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))


def oracle_sql(base=BASE, notices=(*NOTICES, *WHOLE)) -> str:
    rows = [f"({t}, '{label}', {str(is_base).lower()}, {words}, {size}, {i}, '{gram}')"
            for t, label, is_base, words, size, i, gram in gram_rows(base, notices)]
    return rf"""
WITH t(template, label, is_base, words, size, tpos, gram) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS pos FROM d),
n AS (SELECT doc_id, pos, a || ' ' || lead(a) OVER p AS two, a || ' ' || lead(a) OVER p || ' ' || lead(a, 2) OVER p AS three
      FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, pos, two AS gram FROM n UNION ALL SELECT doc_id, pos, three FROM n),
v AS (SELECT doc_id, template, label, is_base, words, size, tpos, pos - tpos AS diagonal FROM g JOIN t USING (gram)),
v1 AS (SELECT *, tpos - row_number() OVER (PARTITION BY doc_id, template, diagonal ORDER BY tpos) AS run FROM v),
r AS (SELECT doc_id, template, label, is_base, words, size, diagonal, min(tpos) AS t0, max(tpos) AS t1,
             diagonal + min(tpos) AS s, diagonal + max(tpos) + size AS e
      FROM v1 GROUP BY doc_id, template, label, is_base, words, size, diagonal, run),
b0 AS (SELECT doc_id, label, diagonal FROM r WHERE is_base AND t0 = 0 AND t1 = words - size),
r1 AS (SELECT *, max(e) OVER (PARTITION BY doc_id, template ORDER BY s, e DESC, t0
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
r2 AS (SELECT *, lag(t1) OVER o AS before, lag(diagonal) OVER o AS last FROM r1 WHERE reach IS NULL OR e > reach
       WINDOW o AS (PARTITION BY doc_id, template ORDER BY s, e DESC, t0)),
r3 AS (SELECT *, CASE WHEN t0 > before AND abs(diagonal - last) <= {GAP} THEN 0 ELSE 1 END AS new FROM r2),
r4 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY s, e DESC, t0) AS chain FROM r3),
s AS (SELECT doc_id, label, sum(t1 + size - CASE WHEN new = 1 THEN t0 ELSE greatest(t0, before + size) END) / CAST(words AS DOUBLE) AS cover
      FROM r4 GROUP BY doc_id, template, label, words, chain HAVING max(e) - min(s) <= words * {1 + STRETCH}::DOUBLE + {GAP}),
x AS (SELECT doc_id, label, cover FROM s WHERE cover >= {MIN_COVER}
      UNION ALL SELECT doc_id, label, 1.0 FROM b0),
b AS (SELECT doc_id, count(*) AS n_base, CAST(min(diagonal) AS BIGINT) AS first_word,
             CAST(max(diagonal) AS BIGINT) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b0 GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN y ON d.doc_id = y.doc_id
"""
