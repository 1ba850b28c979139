"""License scans by diagonal voting.

Rolling k-gram hashes of a document's words are joined to the places of the same k-grams in license templates.  Hits
with equal offset (place in the text minus place in the template) lie on one diagonal; votes are counted per diagonal,
diagonals of one template that lie close are merged, and the span is verified by the share of the template's k-grams
that it holds in order.  k-grams that no template has are dropped inside the row (a hash set), so no text and no
window is shuffled; the join compares the words too.  Everything runs on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm import native

#: fixed: phrases whose places are counted, and their labels
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: fixed: opening words of public license notices
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]
MAX_TEMPLATE_GRAMS = 50_000


def template_frame(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Templates (template, label, words, phrase): phrases must stand whole, notices may be altered."""
    rows = [(i, label, text, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *notices])]
    return spark.createDataFrame(rows, "template int, label string, text string, phrase boolean")


def scan(docs: DataFrame, templates: DataFrame, k: int = 3, min_share: float = 0.6, drift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places of whole phrases give the base columns.  A notice adds its label if merged diagonals, at most ``drift``
    words apart, hold at least ``min_share`` of its k-grams.  ``score`` is the best share (1 for a phrase, 0 for none).
    Null and empty texts have no words and no labels; repeated rows are judged one by one; an empty template table
    finds nothing.  Templates have at least k words (others raise) and MAX_TEMPLATE_GRAMS k-grams in all (else it raises).
    """
    cut = templates.withColumn("w", native.words(F.col("text"))).withColumn("grams", F.size("w") - k + 1)
    if cut.where(F.col("grams") < 1).limit(1).count():
        raise ValueError(f"a template has fewer than {k} words")
    places = cut.select("template", "label", "phrase", "grams", F.explode(F.sequence(F.lit(1), "grams")).alias("place"), "w")
    places = places.select("template", "label", "phrase", "grams", "place", F.array_join(F.slice("w", F.col("place"), k), " ").alias("gram"), F.xxhash64(F.slice("w", F.col("place"), k)).alias("hash"))
    known = places.select("hash").distinct().limit(MAX_TEMPLATE_GRAMS + 1).collect()
    if len(known) > MAX_TEMPLATE_GRAMS:
        raise ValueError("too many template k-grams for a hash set")
    rows = docs.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).alias("id"), native.words(F.col(text_col)).alias("w"))
    at = native.starts(F.size("w"), k)
    likely = F.filter(at, lambda i: F.xxhash64(F.slice(F.col("w"), i, k)).isin([r["hash"] for r in known])) if known else F.array().cast("array<int>")
    grams = F.transform(likely, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(F.col("w"), i, k)).alias("hash"), F.array_join(F.slice(F.col("w"), i, k), " ").alias("gram")))
    # one document's rows stay together from here: three groupings, one exchange of hits
    hits = rows.select("tag", "id", F.size("w").alias("n_words"), F.explode_outer(grams).alias("hit")).select("tag", "id", "n_words", "hit.*")
    votes = hits.join(F.broadcast(places), ["hash", "gram"], "left").repartition("tag")
    lines = votes.groupBy("tag", "id", "n_words", "template", "label", "phrase", "grams", (F.col("at") - F.col("place")).alias("offset")).agg(
        F.count_distinct("place").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("tag", "template").orderBy("offset", "first")
    apart = F.coalesce(F.col("phrase") | (F.col("offset") - F.lag("offset").over(order) > drift), F.lit(True))
    blocks = lines.withColumn("block", F.sum(apart.cast("int")).over(order))
    # an altered notice shifts to a neighbouring diagonal at each insertion or deletion, so votes of a block add up
    spans = blocks.groupBy("tag", "id", "n_words", "template", "label", "phrase", "grams", "block").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.withColumn("share", F.least(F.col("votes") / F.col("grams"), F.lit(1.0)))
    whole = F.col("phrase") & (F.col("votes") == F.col("grams"))
    near = ~F.col("phrase") & (F.col("share") >= min_share) & (F.col("last") - F.col("first") < 2 * (F.col("grams") + k))
    joined = lambda keep: F.array_join(F.sort_array(F.collect_set(F.when(keep, F.col("label")))), ",")
    return spans.groupBy("tag", "id", "n_words").agg(
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("first") - 1)).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("first") - 1)).cast("long").alias("last_word"),
        joined(whole).alias("base_labels"),
        joined(whole | near).alias("labels"),
        F.coalesce(F.max(F.when(whole | near, F.col("share"))), F.lit(0.0)).alias("score"),
    ).select(F.col("id").alias(id_col), F.col("n_words").cast("long"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
