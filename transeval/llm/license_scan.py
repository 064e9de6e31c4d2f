"""License scans by diagonal voting.

Templates and texts are taken as words; each two neighbouring words make a gram. The grams of
all texts are joined by hash to the places of equal grams in the templates, and the words
themselves are compared. A pair of places votes for its diagonal, the text place minus the
template place: the words of one occurrence all vote for the word where it starts. A phrase
stands where one diagonal has all its grams. A longer template may have lost or gained words,
which moves the rest of it to a diagonal near by; neighbouring diagonals are merged up to a
drift of ``DRIFT`` words, and the template is a candidate where enough of its grams have voted.

A candidate's span reaches from the first word voted for to the last. It is verified word by
word, in order: the words inserted, lost or replaced between the span and the template, as a
share of the longer of the two, are what it lacks of 1. Where spans of several templates overlap,
the one verified best stands (of equals the one with more of its votes), so a license is told
from its relatives, which differ in a word.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, ascii_lower, words_of

#: Fixed values of the contract: phrases and their labels.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
#: Well-known sentences of public license notices, and the labels the method adds for them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    *[(label, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} License")
      for label, name in (("gpl", "General Public"), ("lgpl", "Lesser General Public"), ("agpl", "Affero General Public"))],
    *[(label, f"This work is licensed under the GNU {name} License, version {version}")
      for label, name, version in (("gpl", "General Public", "3"), ("gpl", "General Public", "2"), ("lgpl", "Lesser General Public", "3"),
                                   ("lgpl", "Lesser General Public", "2.1"), ("agpl", "Affero General Public", "3"))],
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    *[(f"cc-by-{short}", f"This work is licensed under a Creative Commons Attribution-{name} 4.0 International License")
      for short, name in (("nc", "NonCommercial"), ("sa", "ShareAlike"), ("nd", "NoDerivatives"), ("nc-sa", "NonCommercial-ShareAlike"), ("nc-nd", "NonCommercial-NoDerivatives"))],
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Diagonals at most so far apart are one occurrence of a template; its first and last are at
#: most ``DRIFT`` apart.
NEAR, DRIFT = 3, 12
#: A template is a candidate if this share of its grams has voted, and stands if this share of
#: its span is as in the template.
VOTED, ENOUGH = 0.5, 0.9
#: A template's votes are bits of one long, its words characters from this one on.
MOST_GRAMS = 62
FIRST_CODE = 48
#: The template of the row that each document has, with or without votes.
EVERY = -1


def words_in(text: str) -> list[str]:
    return re.findall(WORD_PATTERN, text.lower())


def template_rows() -> list[tuple]:
    """(template, is a phrase, label, grams in all, its words, place, gram's two words)."""
    out = [(EVERY, False, None, 0, [], 0, None, None)]
    for t, (phrase, (label, text)) in enumerate([*((True, p) for p in PHRASES), *((False, p) for p in TEMPLATES)]):
        words = words_in(text)
        if len(words) > MOST_GRAMS + 1:
            raise ValueError(f"template of more than {MOST_GRAMS + 1} words: {text}")
        out += [(t, phrase, label, len(words) - 1, words, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return out


def _labels(condition: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")


def coded(words: Column, template: Column) -> Column:
    """Words as characters: the place in the template of the first equal word."""
    return F.array_join(F.transform(words, lambda w: F.char(F.array_position(template, w) + F.lit(FIRST_CODE))), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each
    document, whose key is id and text: rows that repeat both are one document.

    ``score`` is 1 where a phrase stands, else how well the best template that stands was
    verified, else 0. Null and empty texts have no words; other columns of ``docs`` are not
    read. The templates are a fixed list, so joining them by broadcast has a fixed size.
    """
    spark: SparkSession = docs.sparkSession
    gram_hash = F.when(F.col("a_").isNull(), F.lit(0)).otherwise(F.xxhash64("a_", "b_"))
    templates = F.broadcast(spark.createDataFrame(
        template_rows(), "template int, phrase boolean, label string, grams int, template_words array<string>, place int, a_ string, b_ string")
        .withColumn("hash_", gram_hash))
    words = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm")).select(
        "doc_id", F.xxhash64("norm").alias("text_hash"), words_of(F.col("norm")).alias("words"))
    size = F.size("words")
    # one entry more than there are grams, so that every document meets a template
    hashes = F.concat(F.transform(F.slice("words", 2, F.greatest(size - 1, F.lit(0))), lambda w, i: F.xxhash64(F.get(F.col("words"), i), w)),
                      F.array(F.lit(0).cast("long")))
    grams = words.select("doc_id", "text_hash", "words", size.alias("n_words"), F.posexplode(hashes).alias("at", "hash"))
    last = F.col("at") == F.greatest(F.col("n_words") - 1, F.lit(0))
    equal = (F.get(F.col("words"), F.col("at")) == F.col("a_")) & (F.get(F.col("words"), F.col("at") + 1) == F.col("b_"))
    votes = grams.join(templates, (F.col("hash") == F.col("hash_")) & F.when(F.col("template") == EVERY, last).otherwise(equal))
    # the words around a diagonal, as the template sees them: all that its candidate can span
    start = F.greatest(F.col("at") - F.col("place"), F.lit(0))
    around = F.slice("words", start + 1, F.col("grams") + 1 + DRIFT)
    beside = votes.select(
        "doc_id", "text_hash", "template", "phrase", "label", "grams", F.col("n_words").cast("long").alias("n_words"),
        (F.col("at") - F.col("place")).alias("diagonal"), start.alias("start"), "at", "template_words",
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place")).alias("vote"), F.when(~F.col("phrase") & (F.col("template") != EVERY), around).alias("around"))
    seen = beside.withColumn("region", F.when(F.size("around") > 0, coded(F.col("around"), F.col("template_words")))).withColumn(
        "own", F.when(F.col("region").isNotNull(), coded(F.col("template_words"), F.col("template_words")))).drop("around", "template_words")
    key = ["doc_id", "text_hash"]
    # all that follows needs the rows of a document together, and nothing else
    seen = seen.repartition(*key)
    diagonals = seen.groupBy(*key, "template", "phrase", "label", "grams", "n_words", "diagonal", "start", "region", "own").agg(
        F.bit_or("vote").alias("mask"), F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > NEAR
    run = Window.partitionBy(*key, "template", "run").orderBy("diagonal").rangeBetween(0, DRIFT)
    merged = (diagonals.withColumn("run", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
              .withColumns({"votes": F.bit_or("mask").over(run), "first": F.min("first").over(run), "last": F.max("last").over(run)}))
    span = F.substring(F.col("region"), F.col("first") - F.col("start") + 1, F.col("last") - F.col("first") + 2)
    candidate = F.col("region").isNotNull() & (F.bit_count("votes") >= F.col("grams") * F.lit(VOTED))
    lacking = F.levenshtein(span, F.col("own")) / F.greatest(F.length(span), F.length("own"))
    checked = merged.withColumn("share", F.when(candidate, F.lit(1.0) - lacking)).withColumn("verified", F.coalesce(F.col("share") >= ENOUGH, F.lit(False)))
    # overlapping spans of verified templates: the best stands
    placed = Window.partitionBy(*key, "verified").orderBy("first", "last", "template")
    reach = F.max("last").over(placed.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(placed)
    best = Window.partitionBy(*key, "verified", "island").orderBy(
        F.col("share").desc(), (F.bit_count("votes") / F.greatest(F.col("grams"), F.lit(1))).desc(), F.col("grams").desc(), "template", "diagonal")
    stands = checked.withColumn("reach", reach).withColumn("island", F.when(F.col("verified"), island)).withColumn(
        "stands", F.col("verified") & (F.row_number().over(best) == 1))
    base = F.col("phrase") & (F.bit_count("mask") == F.col("grams"))
    return (stands.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(base | F.col("stands")).alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(F.col("stands"), F.col("share"))), F.lit(0.0)).alias("score")).drop("text_hash"))
