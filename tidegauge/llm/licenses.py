"""License scans by diagonal voting.

All rolling three-word hashes of every text are joined by Spark to the places where they stand in the license templates. A hit votes for the
diagonal (place in the text minus place in the template). Votes are collected per diagonal, neighbouring diagonals of a template are merged into
one span (a few words may be missing or added), and a span is verified by the template's places it holds, each counted once: it counts only if these are enough. Of
spans that share words the one that holds most of its template wins, so a notice is not also taken for one that differs in a word. A diagonal that holds
all of a phrase's hashes is a place where its words stand consecutively; these places always count.

Null and empty texts have no words and no labels; of equally good spans that of the template listed first stays; null ids and repeated rows are returned as they come; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import batches as B

GRAM = 3
#: Diagonals this close belong to one span.
SLACK = 3
#: Share of a template's hashes that a span must cover.
COVER = 0.8
#: Template places in one number of a bit set.
PLACES = 60
#: A template list of at most this many hashes is broadcast (24 bytes each); a longer one is joined as Spark decides.
BROADCAST_GRAMS = 100_000

# The phrases that every scan must find, and their labels
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
# Opening words of published licenses and notices
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
)


def template_places(spark, phrases=PHRASES, templates=TEMPLATES, gram: int = GRAM) -> tuple[DataFrame, int]:
    """(gram, template, label, base, n_grams, at) of every template hash, and how many there are. Templates have ``gram`` words at least."""
    entries = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    offsets, data = B.texts(pa.array([text for _, text, _ in entries], pa.string()))
    rows, words = B.words(offsets, data, 0, len(entries), B.ALNUM)
    hashes, whole = B.grams(rows, words, gram)
    places = np.flatnonzero(whole)
    of = rows[places]
    first = np.searchsorted(rows, np.arange(len(entries)))
    sizes = np.bincount(of, minlength=len(entries))
    if (sizes == 0).any():
        raise ValueError(f"a template needs at least {gram} words")
    # the hash 0 stands before the first word of every text, so each text keeps a row of its own
    values = [(0, -1, None, False, 1, 0)]
    values += [(int(h), int(t), entries[t][0], entries[t][2], int(sizes[t]), int(p - first[t])) for h, t, p in zip(B.signed(hashes)[places], of, places)]
    return spark.createDataFrame(values, "gram long, template int, label string, base boolean, n_grams int, at int"), len(values)


def _rolling(gram: int):
    def work(batch: pa.RecordBatch):
        offsets, data = B.texts(batch.column("text"))
        for first, last in B.groups(offsets):
            rows, words = B.words(offsets, data, first, last, B.ALNUM)
            n = last - first
            hashes, whole = B.grams(rows, words, gram)
            owner = rows[: len(hashes)][whole]
            counts = np.bincount(owner, minlength=n)
            begins = np.cumsum(counts) - counts
            values = np.insert(B.signed(hashes)[whole], begins, 0)
            part = batch.slice(first, n)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(B.per_row(rows, n)), B.lists(values, counts + 1)], ["id", "key", "n_words", "grams"])

    return work


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, gram: int = GRAM, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.length(text)).alias("key"), text.alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rolled = B.over_text(source, "text", f"id {kind}, key long, n_words long, grams array<long>", _rolling(gram))
    places, size = template_places(docs.sparkSession, phrases, templates, gram)
    each = rolled.select("id", "key", "n_words", F.posexplode("grams").alias("pos", "gram"))
    hits = each.join(F.broadcast(places) if size <= BROADCAST_GRAMS else places, "gram").select(
        "id", "key", "n_words", "template", "label", "base", "n_grams", "at", (F.col("pos") - 1 - F.col("at")).cast("long").alias("diagonal"),
    )
    of = ["id", "key", "n_words", "template", "label", "base", "n_grams"]
    text_of = of[:3]
    sets = range(1 + max(r["at"] for r in places.agg(F.max("at").alias("at")).collect()) // PLACES)
    held = lambda i: F.when(F.floor(F.col("at") / PLACES) == i, F.expr(f"shiftleft(1L, at % {PLACES})")).otherwise(F.lit(0).cast("long"))
    many = lambda prefix: sum((F.bit_count(f"{prefix}{i}") for i in sets), F.lit(0))
    # summed where the hits are, so copies of a text meet as one row a task
    votes = hits.groupBy(*of, "diagonal").agg(*[F.bit_or(held(i)).alias(f"b{i}") for i in sets], F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("rows"))
    votes = votes.withColumn("votes", many("b"))
    along = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    cut = votes.withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(along)).withColumn(
        "span", F.sum(F.when(F.col("gap") <= slack, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)),
    )
    exact = (F.col("votes") == F.col("n_grams")) & F.col("base")
    spans = cut.groupBy(*of, "span").agg(
        *[F.bit_or(f"b{i}").alias(f"s{i}") for i in sets], F.min(F.col("diagonal") + F.col("low")).alias("from"),
        (F.max(F.col("diagonal") + F.col("high")) + gram).alias("until"), F.count_if(exact).alias("places"), F.min(F.when(exact, F.col("diagonal"))).alias("first"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last"), F.max("rows").alias("rows"),
    ).withColumn("got", many("s")).withColumn("covered", F.col("got") / F.col("n_grams"))
    is_text = F.col("template") < 0
    good = ~is_text & ((F.col("covered") >= cover) & ((F.col("until") - F.col("from")) <= F.col("n_grams") + gram - 1 + 2 * slack) | (F.col("places") > 0))
    # spans that share words form an island; its best one stays
    before = Window.partitionBy("id", "key").orderBy("from", "until", "template", "span")
    reach = F.max(F.when(good, F.col("until"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("fresh", F.when(reach.isNull() | (F.col("from") >= reach), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.when(good, F.struct("got", "covered", -F.col("template")))
    spans = apart.withColumn("wins", good & ((F.col("places") > 0) | (rank == F.max(rank).over(Window.partitionBy("id", "key", "island")))))
    found = spans.groupBy(*text_of).agg(
        F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("places") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("wins"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(~is_text, F.when(F.col("places") > 0, F.lit(1.0)).otherwise(F.col("covered"))).otherwise(F.lit(0.0))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("wins"), F.struct("from", "until", "label")))).alias("spans"),
        F.max(F.when(is_text, F.col("rows"))).alias("copies"),
    )
    return found.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans",
    )
