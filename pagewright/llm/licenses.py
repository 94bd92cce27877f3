"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-gram hashes of every text are joined with the positions
they have in license templates.  A hit votes for its diagonal (place in the
text minus place in the template), neighbouring diagonals merge, so small
insertions and deletions keep one span, and a span counts if enough of the
template's positions voted and it is not much longer than the template.  Hits
compare the words themselves, so equal hashes of other words do not count.
Short phrases are templates too, all of whose positions must vote.

The templates are fixed, so is the size of their table, which is broadcast.
A row that no text lacks carries the number of words: texts are read once.

Defined cases: null or wordless text has no words, no places and score 0;
repeated rows are each reported; ties cannot arise, spans are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license, and passages of public license texts.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
PASSAGES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]
#: Words per hashed gram of phrases and of passages.
SHORT, LONG = 2, 4
#: Diagonals this near merge; share of positions that must vote; longest span, in template lengths.
NEAR, SHARE, STRETCH = 6, 0.6, 1.5


def _grams(words: Column, hashes: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words."""
    last = F.size(words) - k
    some = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + n) for n in range(k)]))
    return F.when(last >= 0, some).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame) -> DataFrame:
    """Adds the arrays ``short`` and ``long`` of gram hashes to ``words``."""
    hashed = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    words, hashes = F.col("words"), F.col("hashes")
    return hashed.withColumn("short", _grams(words, hashes, SHORT)).withColumn("long", _grams(words, hashes, LONG)).drop("hashes")


def templates(spark: SparkSession) -> DataFrame:
    """One row per template position (template, label, base, k, positions,
    length, place, own words) and one for the row every text has (template -1)."""
    rows = [(n, label, True, SHORT, text.split()) for n, (text, label) in enumerate(PHRASES)]
    rows += [(len(PHRASES) + n, label, False, LONG, text.split()) for n, (text, label) in enumerate(PASSAGES)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, k int, words array<string>")
    grams = F.when(F.col("base"), F.col("short")).otherwise(F.col("long"))
    placed = _hashed(table).select(
        "template", "label", "base", "k", F.size(grams).alias("positions"), F.size("words").alias("length"),
        F.col("words").alias("own"), F.posexplode(grams).alias("place", "gram"),
    )
    every = placed.limit(1).select(
        F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("k"),
        F.lit(1).alias("positions"), F.lit(0).alias("length"), F.col("own"), F.lit(0).alias("place"), _every().alias("gram"),
    )
    return placed.unionByName(every)


def _every() -> Column:
    return F.xxhash64(F.lit(0))


def license_spans(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Spans of templates in texts: the ``keep`` columns, mark (text hash),
    template, label, base, first and last word, share of positions that voted,
    passed; and per text one row of template -1 with its n_words and copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = _hashed(docs.select(
        *keep, F.xxhash64(text).alias("mark"), F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)).alias("words")
    ))
    grams = words.select(
        *keep, "mark", "words", F.size("short").alias("n_short"),
        F.posexplode(F.concat("short", "long", F.array(_every()))).alias("at", "gram"),
    )
    at = F.when(F.col("k") == LONG, F.col("at") - F.col("n_short")).when(F.col("k") == SHORT, F.col("at")).otherwise(0)
    same = F.slice("words", F.col("place0") + 1, F.greatest("k", F.lit(1))) == F.slice("own", F.col("place") + 1, F.greatest("k", F.lit(1)))
    hits = (
        grams.join(F.broadcast(templates(docs.sparkSession)), "gram").withColumn("place0", at)
        .where((F.col("template") < 0) | same)
        .select(
            *keep, "mark", "template", "label", "base", "k", "positions", "length", "place", F.col("place0").alias("at"),
            F.when(F.col("template") < 0, F.size("words")).alias("n_words"),
        )
        # few rows are left; all that follows keeps this partitioning
        .repartition(*keep, "mark")
    )
    text_key = [*keep, "mark"]
    kind = ["template", "label", "base", "k", "positions", "length"]
    diagonals = hits.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*text_key, *kind, "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max(F.col("at") + F.col("k") - 1).alias("last"),
        F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"),
    )
    in_order = Window.partitionBy(*text_key, "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(in_order) > NEAR)
    merged = (
        diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("part", F.sum("new").over(in_order))
        .groupBy(*text_key, *kind, "part").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("first").alias("first"),
            F.max("last").alias("last"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies"),
        )
    )
    share = F.col("votes") / F.col("positions")
    fits = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("length")
    passed = F.when(F.col("base"), F.col("votes") == F.col("positions")).otherwise((share >= SHARE) & fits)
    return merged.withColumn("share", share).withColumn("passed", (F.col("template") >= 0) & passed)


def license_scan(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_base, first_word,
    last_word, base_labels, labels and score (the best share of a template)."""
    spans = license_spans(docs, keep)
    found, base = F.col("passed"), F.col("passed") & F.col("base")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    scan = spans.groupBy(*keep, "mark").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"), joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"),
    )
    return scan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("mark", "copies", "copy")
