"""License scan by diagonal voting.

Templates are phrases and notices. The hash of every rolling word k-gram of a document is joined to the grams of all
templates, and the words of both are compared. A hit at document word p of template word t votes for the diagonal p - t, on
which the template would stand from there. Diagonals at most ``SHIFT`` words apart are merged, so that a notice with words
put in, left out or exchanged gathers the votes of all its pieces. The span of a diagonal is verified by the template
words that its hits and its neighbours' cover; each was compared in place. A phrase stands where its own diagonal has all.

Defined results: null and empty texts have no words and no labels; a template of fewer words than a gram is one gram, one
without words finds nothing; every place counts, overlapping ones too; repeated ids and rows are documents of their own;
texts of any length are scanned whole; no templates or an empty table give no labels or no rows; other columns are never
looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, durable, read, words
from .decontaminate import window_hits

GRAM, SHIFT, SHARE = 4, 8, 0.75

# The phrases of the base rule, and the words of public notices.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
NOTICES = [
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def templates(spark: SparkSession, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, gram: int = GRAM) -> DataFrame:
    """(template, label, base, words, k) of all that have words; k is the length of its grams."""
    rows = [(i, label, i < len(phrases), text) for i, (label, text) in enumerate([*phrases, *notices])]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, text string")
    return table.select("template", "label", "base", words(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(gram)))


def gram_places(table: DataFrame) -> tuple[DataFrame, list[int]]:
    """(hash, k, win, items) of every distinct gram of :func:`templates`, items as 'template:word', and the lengths there are."""
    at = table.select("template", "k", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("t"))
    grams = at.select("k", F.slice("words", F.col("t") + 1, F.col("k")).alias("win"), F.concat_ws(":", "template", "t").alias("place"))
    grams = durable(grams.groupBy("k", "win").agg(F.sort_array(F.collect_set("place")).alias("items")).withColumn("hash", F.xxhash64("win")))
    return grams, sorted(r.k for r in grams.select("k").distinct().collect())  # at most `gram` values


def diagonals(hits: DataFrame, table: DataFrame, shift: int = SHIFT) -> DataFrame:
    """hits of ``window_hits`` by rid: for each document's diagonals label, base, place (all of its own grams) and share (of the template's words, with the diagonals beside it); one row without label for a document without hits."""
    votes = hits.repartition("rid").select("rid", "id", "n_words", "at", F.explode_outer("items").alias("place"))
    votes = votes.select("rid", "id", "n_words", "at", *[F.split_part("place", F.lit(":"), F.lit(i)).cast("int").alias(c) for i, c in ((1, "template"), (2, "t"))])
    lines = votes.groupBy("rid", "id", "n_words", "template", (F.col("at") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))
    sizes = table.select("template", "label", "base", "k", F.size("words").alias("size"))
    lines = lines.join(F.broadcast(sizes), "template", "left")  # as many rows as templates
    near = W.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(-shift, shift)
    merged = lines.withColumn("merged", F.array_distinct(F.flatten(F.collect_list("ts").over(near))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("merged", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    return merged.select("rid", "id", "n_words", "label", "base", "diagonal", (F.size("ts") == F.col("size") - F.col("k") + 1).alias("place"), F.when(F.col("label").isNotNull(), covered / F.col("size")).alias("share"))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, gram: int = GRAM, shift: int = SHIFT, share: float = SHARE) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template that a span covers)."""
    table = durable(templates(df.sparkSession, phrases, notices, gram))
    grams, lengths = gram_places(table)
    docs = df.select(F.monotonically_increasing_id().alias("rid"), col(id_col).alias("id"), words(col(text_col)).alias("words"))
    found = diagonals(window_hits(docs, grams, lengths), table, shift)
    stands, start = F.col("base") & F.col("place"), F.col("diagonal").cast("long")
    spans = stands | (~F.col("base") & (F.col("share") >= share))
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return found.groupBy("rid", "id", "n_words").agg(
        F.count_if(stands).alias("n_base"),
        F.min(F.when(stands, start)).alias("first_word"),
        F.max(F.when(stands, start)).alias("last_word"),
        names(stands).alias("base_labels"),
        names(spans).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
with t as (
  select template, label, base, w, len(w) as size, least(len(w), 4) as k from (select template, label, base, regexp_extract_all(text, '[a-z0-9]+') as w from (values %s) as v(template, label, base, text))
), tg as (select template, k, i - 1 as t, w[i:i + k - 1] as win from (select *, unnest(generate_series(1, size - k + 1)) as i from t)
), d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), dg as (
  select rid, k, i - 1 as p, w[i:i + k - 1] as win from (select rid, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from d, (select distinct k from t) where len(w) >= k)
), hit as (select rid, template, p - t as diagonal, t from dg join tg on dg.k = tg.k and dg.win = tg.win
), line as (select rid, template, diagonal, count(distinct t) as votes from hit group by all
), cover as (
  select l.rid, l.template, l.diagonal, count(distinct x) as covered
  from line l join (select rid, hit.template, diagonal, unnest(generate_series(t, t + k - 1)) as x from hit join t on t.template = hit.template) h on h.rid = l.rid and h.template = l.template and abs(h.diagonal - l.diagonal) <= 8
  group by all
), s as (
  select rid, label, base, diagonal, votes = size - k + 1 as place, covered / size as share from line join cover using (rid, template, diagonal) join t using (template)
), r as (
  select rid, count(*) filter (base and place) as n_base, min(diagonal) filter (base and place) as first_word, max(diagonal) filter (base and place) as last_word,
    string_agg(distinct label, ',' order by label) filter (base and place) as base_labels, string_agg(distinct label, ',' order by label) filter (base and place or not base and share >= 0.75) as labels, max(share) as score
  from s group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join r using (rid)
""" % ", ".join(f"({i}, '{label}', {i < len(PHRASES)}, '{text}')" for i, (label, text) in enumerate([*PHRASES, *NOTICES]))  # fmt: skip
