"""License scanning by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of the texts are joined to the positions at which the
templates have them.  A hit votes for the diagonal ``place in text - place in
template``; a verbatim copy puts all its votes on one.  Votes of neighbouring
diagonals, where a word was put in or left out, are merged, and a merged span counts
if enough of the template's k-grams voted and it isn't much longer than the template.

Words are runs of ASCII letters and digits and of other non-ASCII characters, A-Z in
lower case.  The templates are a fixed list of a few kB, so their side is broadcast.

Texts are read once: a marker behind each text's k-grams meets a marker template, so
that every text has a vote, whose place tells its number of words.

Edge cases: null and empty texts have no words and no places; phrases that overlap are
counted each; rows of the same doc_id and text get the same result; rows without
doc_id are scanned too; very long texts are scanned whole, and only their hits leave a
task; an empty table gives an empty result; other columns, also of the names used
here, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Stage, table

K = 3
# Phrases of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of widely used licenses, and the label of each.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0 1 0 universal": "cc0",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1",
    "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit": "cc-by",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit": "cc-by-sa",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
}
#: Templates of up to so many words must match whole; of longer ones this share of k-grams must vote.
SHORT, SHARE = 8, 0.6
#: Templates that mark a text of k words or more, and a shorter one.
WORDED, SHORT_TEXT = -1, -2
#: Neighbouring diagonals at most so far apart are merged.
NEIGHBOUR = 2


def words_of(text: Column) -> Column:
    """The words.  Two letters whose lower case is ASCII are first put into others that stay words."""
    plain = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")), F.lit("\u0130"), F.lit("\u00e5")))
    return F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(words: Column) -> Column:
    """Hash of the k words from each place on; none if there are fewer than k."""
    at = lambda i: F.xxhash64(*(words[i + j] for j in range(K)))
    return F.when(F.size(words) >= K, F.transform(F.sequence(F.lit(0), F.size(words) - K), at))


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """``template, label, is_base, grams, hash, at``: a row for each k-gram of each template."""
    rows = [(n, label, is_base, len(p.split()), p.split()) for n, (p, label, is_base) in enumerate([*((p, v, True) for p, v in base.items()), *((p, v, False) for p, v in notices.items())])]
    given = spark.createDataFrame(rows, "template int, label string, is_base boolean, size int, words array<string>")
    return given.select("template", "label", "is_base", "size", F.posexplode(gram_hashes(F.col("words"))).alias("at", "hash"))


def votes(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, template, label, is_base, size, diagonal, ats``: the template places that voted for each diagonal.

    ``mark`` is a hash of the text.  Templates below 0 mark the text itself: ``n_words``, and ``copies`` of the row.
    """
    spark = docs.sparkSession
    told = templates(spark, base, notices)
    marks = spark.createDataFrame([(WORDED, None, None, 0, 0, 0), (SHORT_TEXT, None, None, 0, 0, 1)], "template int, label string, is_base boolean, size int, at int, hash long")
    text = F.coalesce(docs[text_col], F.lit(""))
    words = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("mark"), words_of(docs[text_col]).alias("words"))
    # the marker stands behind the k-grams, so that its place tells the number of words, and no row carries the words along
    few = F.concat(F.array_repeat(F.lit(None).cast("long"), F.size("words")), F.array(F.lit(1).cast("long")))
    hashes = F.when(F.size("words") >= K, F.concat(gram_hashes(F.col("words")), F.array(F.lit(0).cast("long")))).otherwise(few)
    grams = words.select("doc_id", "mark", F.posexplode(hashes).alias("pos", "hash"))
    hits = grams.join(F.broadcast(told.unionByName(marks)), "hash")
    n_words = F.when(F.col("template") == WORDED, F.col("pos") + (K - 1)).when(F.col("template") == SHORT_TEXT, F.col("pos")).cast("long")
    diagonal = F.when(F.col("template") >= 0, F.col("pos") - F.col("at")).otherwise(0)
    voted = hits.groupBy("doc_id", "mark", "template", "label", "is_base", "size", diagonal.alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.max(n_words).alias("n_words"), F.count("*").alias("copies"))
    return Stage(spark, "licenses").put(voted, "voted")  # few rows, from one pass over the texts


def spans(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, label, is_base, first_word, n_words, score`` of each place found; ``mark`` is a hash of the text.

    Base phrases appear once for each place at which they stand whole.
    """
    return places(votes(docs, base, notices, id_col, text_col))


def places(voted: DataFrame) -> DataFrame:
    """The spans that the votes make."""
    voted = voted.where("template >= 0")
    whole = F.size("ats") == F.col("size") - (K - 1)
    exact = voted.where(F.col("is_base") & whole).select("doc_id", "mark", "label", "is_base", F.col("diagonal").alias("first_word"), F.col("size").alias("n_words"), F.lit(1.0).alias("score"))
    line = Window.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    jumped = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > NEIGHBOUR).cast("int"), F.lit(0))
    merged = (
        voted.where(~F.col("is_base"))
        .withColumn("jumped", jumped)
        .withColumn("island", F.sum("jumped").over(line))
        .groupBy("doc_id", "mark", "template", "label", "is_base", "size", "island")
        .agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min(F.col("diagonal") + F.array_min("ats")).alias("first_word"), F.max(F.col("diagonal") + F.array_max("ats") + K).alias("end"))
    )
    share = F.size("ats") / (F.col("size") - (K - 1))
    enough = F.when(F.col("size") <= SHORT, share >= 1.0).otherwise(share >= SHARE)
    fits = F.col("end") - F.col("first_word") <= 1.5 * F.col("size") + NEIGHBOUR
    near = merged.where(enough & fits).select("doc_id", "mark", "label", "is_base", "first_word", (F.col("end") - F.col("first_word")).alias("n_words"), share.alias("score"))
    return exact.union(near)


def digest(voted: DataFrame) -> DataFrame:
    """The contract's columns for every row that voted."""
    base = F.col("is_base")
    per = places(voted).groupBy("doc_id", "mark").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    rows = voted.where("template < 0").select("doc_id", "mark", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    same = rows["doc_id"].eqNullSafe(per["doc_id"]) & (rows["mark"] == per["mark"])
    none = lambda c, v: F.coalesce(per[c], F.lit(v)).alias(c)
    return rows.join(per, same, "left").select(rows["doc_id"], "n_words", none("n_base", 0), per["first_word"], per["last_word"], none("base_labels", ""), none("labels", ""), none("score", 0.0))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(votes(table(spark, sf_dir, "documents")))
