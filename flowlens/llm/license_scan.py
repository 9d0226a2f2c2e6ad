"""Licence scan by diagonal voting, with DataFrame functions only.

Every rolling word k-gram (k = 2) of a text is joined by hash to the positions where
a template has that k-gram. A hit at text position p and template position t votes for
the diagonal p - t. Votes are kept as bit sets over template positions, one for each 62
positions of a template, so templates may have any length, partial sums merge and repeated
rows don't count twice. Neighbouring diagonals (words put in or left
out) are merged, and a span is verified by the share of the template's k-grams that it
holds and by its length. The words themselves are compared in the join, so a collision
of hashes never votes.

The template table is a parameter. Up to ``BROADCAST`` k-grams of it are broadcast, a larger
one is joined by shuffling the texts' k-grams; texts are never broadcast. A text is read once: a marker row per document carries its word count.

Cases: null and empty texts have 0 words, no labels and score 0; repeated rows are all
returned; rows of equal id and other text are kept apart by the text's hash; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.textio import ascii_lower

#: K-grams of all templates that are broadcast (some ten MB).
BROADCAST = 200_000
#: Template positions in a bit set.
BITS = 62
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False


#: Base phrases, counted wherever they stand, and licence notices that may be altered a little.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("all-rights-reserved", "all rights reserved"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
)


def template_table(templates: tuple[Template, ...]) -> list[tuple]:
    """Rows (tid, label, base, k-grams of the template, position, first word, second word)."""
    rows = []
    for tid, t in enumerate(templates):
        words = t.words.split()
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {t.words!r}")
        rows += [(tid, t.label, t.base, len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    return rows


def scan(
    docs: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES, near: int = 2, share: float = 0.8
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``near``: largest step between diagonals that are merged. ``share``: k-grams that a
    span must hold. The score is the best share of any template, base phrases included.
    """
    spark = docs.sparkSession
    rows = template_table(templates)
    grams = spark.createDataFrame(rows, "tid int, label string, base boolean, grams int, tpos int, a string, b string")
    mark = spark.createDataFrame([(-1, None, False, 0, 0, None, None, 0)], grams.schema.add("gram", "long"))
    grams = grams.withColumn("gram", F.xxhash64("a", "b")).unionByName(mark)
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    one = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), words.alias("w"))
    at = one.select("id", "th", "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - 2, F.lit(-1)))).alias("p"))
    at = at.withColumns({"wa": F.get("w", F.col("p")), "wb": F.get("w", F.col("p") + 1)})
    at = at.select("id", "th", "n", "p", "wa", "wb", F.when(F.col("p") < 0, F.lit(0)).otherwise(F.xxhash64("wa", "wb")).alias("gram"))
    real = (F.col("p") >= 0) & (F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b"))
    hits = at.join(F.broadcast(grams) if len(rows) <= BROADCAST else grams, "gram").filter(real | (F.col("p") < 0) & (F.col("tid") < 0))
    # diagonals: a set bit for each k-gram of the template that stands on it, in blocks of its positions
    bit, block = F.expr(f"shiftleft(1L, tpos % {BITS})"), F.expr(f"tpos div {BITS}").alias("block")
    diagonals = hits.groupBy("id", "th", "tid", "label", "base", "grams", (F.col("p") - F.col("tpos")).alias("d"), block).agg(
        F.bit_or(bit).alias("bits"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.max("n").alias("n"), F.sum((F.col("tid") < 0).cast("long")).alias("copies")
    )
    by = Window.partitionBy("id", "th", "tid").orderBy("d", "block")
    new = (F.col("d") - F.lag("d").over(by) > near).cast("int")
    alone = F.sum(F.bit_count("bits")).over(Window.partitionBy("id", "th", "tid", "d"))
    # a diagonal is whole if all its blocks are; it is counted where the first one stands
    diagonals = diagonals.withColumns({"part": F.sum(F.coalesce(new, F.lit(0))).over(by), "alone": alone})
    whole = (F.col("alone") == F.col("grams")) & (F.col("block") == 0)
    blocks = diagonals.groupBy("id", "th", "tid", "part", "block").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"),
        F.max("alone").alias("alone"), F.bit_count(F.bit_or("bits")).alias("together"),
        F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("n").alias("n"), F.sum("copies").alias("copies"),
        F.sum(whole.cast("long")).alias("whole"), F.min(F.when(whole, F.col("d"))).alias("first_d"), F.max(F.when(whole, F.col("d"))).alias("last_d"),
    )
    merged = blocks.groupBy("id", "th", "tid", "part").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"),
        F.max("alone").alias("alone"), F.sum("together").alias("together"), (F.max("hi") - F.min("lo") + 1).alias("span"), F.max("n").alias("n"),
        F.sum("copies").alias("copies"), F.sum("whole").alias("whole"), F.min("first_d").alias("first_d"), F.max("last_d").alias("last_d"),
    )
    fits = F.col("span") <= F.col("grams") + near + F.floor(F.col("grams") * (1 - share))
    votes = F.greatest("alone", F.when(fits, F.col("together")).otherwise(0))
    part = F.when(F.col("tid") >= 0, votes / F.col("grams"))
    base, is_in = F.col("base"), F.col("share") >= share
    merged = merged.withColumn("share", part)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = merged.groupBy("id", "th").agg(
        F.max("n").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("whole"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_d"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last_d"))).cast("long").alias("last_word"),
        join(F.when(base & (F.col("whole") > 0), F.col("label"))).alias("base_labels"),
        join(F.when(F.when(base, F.col("whole") > 0).otherwise(is_in), F.col("label"))).alias("labels"),
        F.round(F.coalesce(F.max(F.when(F.when(base, F.col("whole") > 0).otherwise(is_in), F.col("share"))), F.lit(0.0)), 6).alias("score"),
        F.sum("copies").alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
