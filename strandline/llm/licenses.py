"""License scans in DataFrame functions: base phrases by place, and a positional index of rare licence words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, template, mandatory key phrases): public licence notices in lower-case words (fixed values). A template is
#: matched by the relative places of its rarest words that the file holds.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "released under the mit license", ("the mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted free of charge",),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        ("apache license version 2", "you may not use this file except in compliance with the license"),
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        ("gnu general public license", "version 3 of the license"),
    ),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies",
        ("permission to use copy modify and or distribute this software",),
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]


def normal_words(text: Column) -> Column:
    """The words of a text, joined by single spaces, with A-Z in lower case; null and wordless texts are empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))


def _n_words(padded: Column) -> Column:
    """Words in a string where each word has a space on either side of its own."""
    return F.floor((F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))) / 2).cast("long")


def _template_words() -> list[str]:
    return sorted({w for _, template, _ in TEMPLATES for w in template.split()})


def postings() -> list[tuple[str, int, int]]:
    """(word, template, offset) of every word of every template."""
    return [(w, n, i) for n, (_, template, _) in enumerate(TEMPLATES) for i, w in enumerate(template.split())]


def word_idf(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(word, idf) of the templates' words over all files of `rows` (lexicon array<string>); also for words unseen."""
    total = rows.count()
    seen = rows.select(F.explode("lexicon").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    every = spark.createDataFrame([(w,) for w in _template_words()], "word string").join(seen, "word", "left")
    return every.select("word", F.greatest(F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)), F.lit(1e-6)).alias("idf"))


def template_matches(files: DataFrame, idf: DataFrame, rarest: int, least: float) -> DataFrame:
    """(file, template, share) from files (file, spots array<struct<pos, word>>).

    The file's `rarest` licence words of highest idf among a template's (ties by the word) each vote, at every place,
    for the place at which the template would start. share is what the best start gathers of the idf of the template's
    own `rarest` words, each place of a word in the template counting once, 1 at most; shares below `least` are left out.
    """
    spark = files.sparkSession
    offsets = spark.createDataFrame(postings(), "word string, template int, offset int")
    words = offsets.groupBy("template", "word").agg(F.count(F.lit(1)).alias("places")).join(idf, "word")
    r = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("idf"), "word"))
    top = words.withColumn("r", r("template")).where(F.col("r") <= rarest)
    weight = top.groupBy("template").agg(F.sum(F.col("idf") * F.col("places")).alias("weight"))
    words, offsets, weight = F.broadcast(words), F.broadcast(offsets), F.broadcast(weight)  # as long as the templates
    held = files.select("file", F.explode(F.array_distinct("spots.word")).alias("word"))
    own = held.join(words, "word").withColumn("r", r("file", "template")).where(F.col("r") <= rarest).select("file", "template", "word", "idf")
    spot = files.select("file", F.explode("spots").alias("s")).select("file", "s.pos", "s.word")
    votes = spot.join(own, ["file", "word"]).join(offsets, ["template", "word"])
    gathered = votes.groupBy("file", "template", (F.col("pos") - F.col("offset")).alias("at")).agg(F.sum("idf").alias("idf")).join(weight, "template")
    share = gathered.groupBy("file", "template").agg(F.least(F.lit(1.0), F.max(F.col("idf") / F.col("weight"))).alias("share"))
    return share.where(F.col("share") >= least - 1e-9)


def scan_licenses(documents: DataFrame, rarest: int = 8, least: float = 0.75) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases count wherever their words stand consecutively. The method takes each file's licence words of highest
    idf, over all files, looks them up in the positional index of the templates, intersects the postings by relative
    position and takes a template whose best place gathers `least` of its rarest words' idf, if all its mandatory
    phrases stand in the file. score is the best verified share, or 1 where a base phrase stands. A null or empty text
    has no words, null places, empty labels and score 0. Repeated rows stay as they are; an empty table gives no rows;
    other columns are not read. Each text is read once; a file without any mandatory phrase is not looked up, as no
    template could be verified. Lexicon and index are as long as the templates, so they are broadcast.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    line = docs.select("doc_id", F.xxhash64("text").alias("h"), normal_words(F.col("text")).alias("line"))
    wide = line.withColumn("wide", F.concat(F.lit(" "), F.replace("line", F.lit(" "), F.lit("  ")), F.lit(" ")))
    n_words = F.when(F.col("line") == "", F.lit(0).cast("long")).otherwise(_n_words(F.col("wide")))
    counted = wide.withColumn("n_words", n_words)
    for n, phrase in enumerate(BASE_PHRASES):
        mark = " " + phrase.replace(" ", "  ") + " "
        has = F.contains(F.col("wide"), F.lit(mark))
        cut = F.split(F.col("wide"), mark)
        counted = counted.withColumn(f"n{n}", F.when(has, F.size(cut) - 1).otherwise(0).cast("long"))
        counted = counted.withColumn(f"f{n}", F.when(has, _n_words(F.substring_index("wide", mark, 1))))
        counted = counted.withColumn(f"l{n}", F.when(has, F.col("n_words") - _n_words(F.substring_index("wide", mark, -1)) - len(phrase.split())))
    span = range(len(BASE_PHRASES))
    labels = [F.when(F.col(f"n{n}") > 0, F.lit(label)) for n, label in enumerate(BASE_PHRASES.values())]
    lexicon = F.array(*[F.lit(w) for w in _template_words()])
    words = F.split("line", " ")
    keys = [F.when(_all_contain(phrases), F.lit(n)) for n, (_, _, phrases) in enumerate(TEMPLATES)]
    any_key = _any_contains(sorted({p for _, _, phrases in TEMPLATES for p in phrases}))
    placed = F.transform(words, lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("word")))
    rows = counted.select(
        "doc_id", "h", "n_words",
        sum((F.col(f"n{n}") for n in span), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[F.col(f"f{n}") for n in span]).alias("first_word"),
        F.greatest(*[F.col(f"l{n}") for n in span]).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
        F.array_intersect(words, lexicon).alias("lexicon"),
        F.when(any_key, F.array_compact(F.array(*keys))).alias("keys"),
        F.when(any_key, F.filter(placed, lambda s: s["word"].isin(_template_words()))).alias("spots"),
    )
    rows = written(rows, "license-rows")

    files = rows.where("size(keys) > 0").dropDuplicates(["doc_id", "h"]).select(F.struct("doc_id", "h").alias("file"), "keys", "spots")
    found = template_matches(files, word_idf(spark, rows), rarest, least)
    label_of = spark.createDataFrame([(n, label) for n, (label, _, _) in enumerate(TEMPLATES)], "template int, label string")
    held = files.select("file", F.explode("keys").alias("template"))
    verified = found.join(held, ["file", "template"]).join(F.broadcast(label_of), "template")
    more = verified.groupBy("file").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    more = more.select(F.col("file.doc_id").alias("d"), F.col("file.h").alias("g"), "more", "share")
    joined = rows.drop("keys", "spots", "lexicon").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _any_contains(phrases: list[str]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(F.col("wide"), F.lit(" " + phrase.replace(" ", "  ") + " "))
    return out


def _all_contain(phrases: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for phrase in phrases:
        out = out & F.contains(F.col("wide"), F.lit(" " + phrase.replace(" ", "  ") + " "))
    return out


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
