"""License scan by diagonal voting.

Every rolling k-gram of words is hashed and joined to the k-gram positions of the templates (a fixed, small
table, so broadcast); the words themselves are compared in the join, so no hash collision counts.  A hit at
word p of the text and word t of the template votes for the diagonal p - t.  Votes are summed per diagonal,
neighbouring diagonals (words put in or left out) are merged, and a merged span is verified by the template
words that its equal k-grams cover.

DataFrame functions only; the text never shuffles, only the votes do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorelog.llm.common import UPPER, stored, whole_text

K = 3
#: A template counts as found when this share of its words is covered.
COVERAGE = 0.8
#: Diagonals this far apart (in words) belong to one occurrence.
DRIFT = 4

#: Fixed values of the contract: phrase and label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Opening statements of public licences, as their texts are published; fixed values.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)

#: All that is neither a digit, a letter nor beyond ASCII parts words.
PARTING = "".join(map(chr, range(128))).translate({ord(c): None for c in "0123456789" + UPPER + UPPER.lower()})
#: Stands behind a text's k-grams, so that every text has a row among the votes.
END = 0


def words_of(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    spaced = F.translate(text, PARTING + UPPER, " " * len(PARTING) + UPPER.lower())
    return F.array_remove(F.split(spaced, " "), "")


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """One row per k-gram of each template: a fixed table of a few hundred rows."""
    rows = []
    for no, (kind, label, text) in enumerate([("base", label, text) for text, label in phrases] + [("method", label, text) for label, text in templates]):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
        if len(words) < k:
            raise ValueError(f"a template needs at least {k} words: {text}")
        rows += [(no, kind, label, len(words), t, *words[t : t + k]) for t in range(len(words) - k + 1)]
    names = [f"g{i}" for i in range(k)]
    rows.append((-1, "text", "", 0, 0, *[""] * k))
    table = spark.createDataFrame(rows, "template int, kind string, label string, length int, t int, " + ", ".join(f"{n} string" for n in names))
    return table.withColumn("g_hash", F.when(F.col("template") < 0, F.lit(END).cast("long")).otherwise(F.xxhash64(*names)))


def votes(texts: DataFrame, grams: DataFrame, k: int = K) -> DataFrame:
    """Rows (doc_id, digest, template, diagonal, seen): the template positions hit on each diagonal.

    Each text also has one row of kind "text", with its number of words and how often the row occurs.  So one
    pass over the texts gives all; the k-grams leave the join only where they equal a template's.
    """
    words = F.col("words")
    rolled = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))))
    rolled = F.concat(rolled, F.array(F.lit(END).cast("long")))
    rows = texts.withColumn("rolled", rolled).select("doc_id", "digest", "words", F.posexplode("rolled").alias("p", "hash"))
    same = F.lit(True)
    for j in range(k):
        same = same & (F.get(words, F.col("p") + j) == F.col(f"g{j}"))
    at_end = (F.col("template") < 0) & (F.col("p") == F.size(words))
    hits = rows.join(F.broadcast(grams), (F.col("hash") == F.col("g_hash")) & (at_end | F.coalesce(same, F.lit(False))))
    hits = hits.select(
        "doc_id", "digest", "template", "kind", "label", "length", "t",
        F.when(at_end, 0).otherwise(F.col("p") - F.col("t")).alias("diagonal"),
        F.when(at_end, F.size(words)).alias("n_words"),
    )
    return hits.groupBy("doc_id", "digest", "template", "kind", "label", "length", "diagonal").agg(
        F.array_sort(F.collect_set("t")).alias("seen"), F.max("n_words").alias("n_words"), F.count_if(F.col("template") < 0).alias("rows")
    )


def spans(found: DataFrame, k: int = K, drift: int = DRIFT) -> DataFrame:
    """Neighbouring diagonals of a template merged: rows (doc_id, digest, kind, label, places, first, last, covered share).

    A merged span ends where the next diagonal is more than ``drift`` words away.  The share is that of the
    template's words that lie in a k-gram with equal words, whatever the diagonal in the span.
    """
    order = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    whole = F.size("seen") == F.col("length") - k + 1
    marked = found.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= drift, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("new").over(order)).withColumn("whole", whole)
    merged = marked.groupBy("doc_id", "digest", "template", "kind", "label", "length", "span").agg(
        F.array_distinct(F.flatten(F.collect_set("seen"))).alias("seen"),
        F.count_if("whole").alias("places"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last"),
        F.min(F.col("diagonal") + F.element_at("seen", 1)).alias("start_word"),
        F.max(F.col("diagonal") + F.element_at("seen", -1) + k).alias("end_word"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda t: F.sequence(t, t + k - 1)))))
    return merged.withColumn("share", covered / F.col("length"))


def license_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored votes of all texts."""
    text = whole_text(text_col)
    # inline() hands on the finished array; as a plain projection, generated code would split the text again for every k-gram
    once = F.inline(F.array(F.struct(F.xxhash64(text).alias("digest"), words_of(text).alias("words"))))
    texts = docs.select(F.col(id_col).alias("doc_id"), once)
    return stored(votes(texts, template_grams(docs.sparkSession)), "op1-votes", ["kind"])


def _verified(coverage: float) -> Column:
    return F.when(F.col("kind") == "base", F.col("places") > 0).otherwise(F.col("share") >= coverage)


def license_spans(found: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The verified spans: doc_id, digest of the text, kind, label, places, first, last, start_word, end_word, share."""
    return spans(found.filter("kind <> 'text'")).filter(_verified(coverage))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels (score 0).  Rows that repeat an id and a text get the same
    result each; rows that share only the id are scanned apart.  Other columns are ignored; an empty table
    gives no rows.  ``score`` is the best covered share of any template, 1 where a base phrase stands; a template
    gives its label from the share ``coverage`` on.
    """
    found = license_votes(docs, id_col, text_col)
    is_base = F.col("kind") == "base"
    verified = spans(found.filter("kind <> 'text'")).withColumn("verified", _verified(coverage)).filter("verified or kind <> 'base'")
    labels = verified.groupBy("doc_id", "digest").agg(
        F.sum(F.when(is_base, F.col("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).alias("first_word"),
        F.max(F.when(is_base, F.col("last"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("label")))), ",").alias("labels"),
        F.max(F.least(F.col("share"), F.lit(1.0))).alias("score"),
    )
    rows = found.filter("kind = 'text'").select("doc_id", "digest", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    same = rows["doc_id"].eqNullSafe(labels["doc_id"]) & (rows["digest"] == labels["digest"])
    return rows.join(labels, same, "left").select(
        rows["doc_id"],
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The method's own labels have no SQL form; the query is tested against brute force.
SQL = None
