"""License scans by diagonal voting, with built-in functions only.

Every rolling k-gram of a document's words is hashed and joined to the positions of that k-gram in the
license templates. A match votes for the diagonal (document position minus template position). The votes of a
diagonal are aggregated, neighbouring diagonals are merged, and a span counts only if the words of its k-grams
are those of the template and cover enough of it.

Defined results. A null text counts as empty; a text without words has n_words 0, no places, empty labels and
score 0. Very long texts are scanned whole. Rows with the same doc_id are scanned one by one. An empty table
gives an empty result. Other columns are ignored. Templates overlap freely: labels are sorted and distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii

K = 3
#: Phrases that must stand as they are, and the label of each (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Passages of license texts and notices (fixed values: public texts, in lower case and without punctuation); a
#: span that holds at least COVERED of the k-grams of a passage gives its label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]
COVERED = 0.8
#: Diagonals at most so far apart are one span: a few words were put in or left out.
NEAR = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def template_rows() -> list[tuple[int, bool, str, int, int, str]]:
    """template, exact, label, t_pos, t_grams, gram: one row for each k-gram of each template."""
    rows = []
    for t, (exact, label, text) in enumerate([(True, label, text) for text, label in PHRASES.items()] + [(False, *x) for x in TEMPLATES]):
        w = text.split()
        rows += [(t, exact, label, p, len(w) - K + 1, " ".join(w[p : p + K])) for p in range(len(w) - K + 1)]
    return rows


def template_grams(spark: SparkSession) -> DataFrame:
    """The rows of the templates with their hash; how many there are is fixed by the tables above."""
    return spark.createDataFrame(template_rows(), "template int, exact boolean, label string, t_pos int, t_grams int, gram string").withColumn("gram_hash", F.xxhash64("gram"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans lists each merged span as label, first and last word and the share of the template it covers. The
    documents are read and split once. Of the k-grams only those of a template pass the join, and each document's
    first, which carries the document itself; what is shuffled is one row for each document and diagonal.
    """
    worded = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w"))
    n = F.size("w")
    grams = worded.select("row", "doc_id", n.cast("bigint").alias("n_words"), F.posexplode_outer(F.when(n >= K, F.slice(F.arrays_zip(F.col("w").alias("a"), F.expr(f"slice(w, 2, {2**31 - 1})").alias("b"), F.expr(f"slice(w, 3, {2**31 - 1})").alias("c")), F.lit(1), n - (K - 1)))).alias("pos", "g"))
    hashed = grams.select("row", "doc_id", "n_words", "pos", F.concat_ws(" ", "g.a", "g.b", "g.c").alias("words"))
    hashed = hashed.withColumn("gram_hash", F.xxhash64("words"))
    template = F.broadcast(template_grams(docs.sparkSession))
    votes = hashed.join(template.withColumnRenamed("gram_hash", "hash"), (F.col("gram_hash") == F.col("hash")) & (F.col("words") == F.col("gram")), "left")
    votes = votes.where(F.col("gram").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    diagonals = votes.groupBy("row", "doc_id", "n_words", "template", "exact", "label", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    jump = F.col("exact") | (F.col("diagonal") - F.lag("diagonal", 1).over(along) > NEAR)
    spans = diagonals.withColumn("span", F.sum(F.coalesce(jump.cast("int"), F.lit(1))).over(along))
    spans = spans.groupBy("row", "doc_id", "n_words", "template", "exact", "label", "t_grams", "span").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.size("seen") / F.col("t_grams")
    spans = spans.withColumn("share", F.coalesce(share, F.lit(0.0)))
    spans = spans.withColumn("good", F.coalesce(F.when(F.col("exact"), F.col("share") == 1).otherwise((F.col("share") >= COVERED) & (F.col("last") - F.col("first") < F.col("t_grams") + 4 * NEAR)), F.lit(False)))
    base = F.col("good") & F.col("exact")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("good")).alias("labels"),
        F.max(F.when(F.col("label").isNull(), 0.0).otherwise(F.col("share"))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("first", (F.col("last") + K - 1).alias("last"), "label", "share")))).alias("spans"),
    ).drop("row")
