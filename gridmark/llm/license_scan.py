"""License scans: a positional index of licence notices, looked up by each file's rarest licence words.

Notices are a fixed table of templates; their postings (word, template, position) have a fixed size, so they are
broadcast. One pass over the texts keeps, per file, its word count, the places of the base phrases and the positions
of licence words; that slim table is written once. Document frequencies of the licence words are counted over all files.
A file's hits on a template's highest-IDF words propose alignments (template, start); all hits vote for alignments by
relative position; an alignment holds when its votes reach a share of the template's weight and every word of the
mandatory phrase stands at its place. No user functions anywhere.

Defined results: a null text counts as empty (no words, no places, empty labels, score 0); files that share id and text
get the same row each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.llm.catalogue import query
from gridmark.llm.common import LOWER, UPPER, read_table, stored

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 4
MIN_SHARE = 0.6
# A base phrase alone, outside any known notice, is half a proof.
PHRASE_SCORE = 0.5

# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Notice:
    """A licence notice in lower case; the words of *phrase* must all be found in place."""

    label: str
    text: str
    phrase: str


# Openings and short forms of published licence notices.
NOTICES = (
    Notice("mit", "released under the mit license", "mit license"),
    Notice("mit", "licensed under the mit license", "mit license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
           "associated documentation files the software to deal in the software without restriction",
           "permission is hereby granted free of charge"),
    Notice("apache", "licensed under the apache license version 2 0", "apache license"),
    Notice("apache", "you may not use this file except in compliance with the license you may obtain a copy of the "
           "license at", "except in compliance with the license"),
    Notice("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
           "general public license as published by the free software foundation", "gnu general public license"),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", "licensed under cc by nc"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
           "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
           "is hereby granted", "permission to use copy modify"),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered"),
)
# Words too common to be looked up.
COMMON = "the of and to in is it or any this a by for with as at be are on an not that from you may can 0 2 3 4".split()


def postings_of(notices=NOTICES) -> list[tuple[str, int, str, int, bool]]:
    """(word, template, label, position, mandatory) of every word worth looking up."""
    rows = []
    for number, notice in enumerate(notices):
        tokens, phrase = notice.text.split(), notice.phrase.split()
        start = next(i for i in range(len(tokens)) if tokens[i : i + len(phrase)] == phrase)
        for i, word in enumerate(tokens):
            if word not in COMMON:
                rows.append((word, number, notice.label, i, start <= i < start + len(phrase)))
    return rows


def _stands_at(tokens: Column, i: Column, parts: list[str]) -> Column:
    match = F.get(tokens, i) == parts[0]
    for k, part in enumerate(parts[1:], 1):
        match = match & F.coalesce(F.get(tokens, i + k) == part, F.lit(False))
    return match


def _places(tokens: Column, positions: Column, phrase: str) -> Column:
    parts = phrase.split()
    return F.filter(positions, lambda i: _stands_at(tokens, i, parts))


def _slim(df: DataFrame, doc_id: str, text: str, vocabulary: list[str]) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    tokens = F.array_remove(F.split(F.translate(value, UPPER, LOWER), BREAKS), "")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(value).alias("text_key"), tokens.alias("tokens"))
    tokens = F.col("tokens")
    inside = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("positions", F.filter(inside, lambda i: F.get(tokens, i).isin(*vocabulary)))
    found = {label: _places(tokens, F.col("positions"), phrase) for phrase, label in PHRASES}
    rows = rows.select(
        "doc_id",
        "text_key",
        F.size(tokens).cast("bigint").alias("n_words"),
        F.struct(*[p.alias(label) for label, p in found.items()]).alias("places"),
        F.transform("positions", lambda i: F.struct(i.alias("position"), F.get(tokens, i).alias("word"))).alias("hits"),
    )
    every = F.concat(*[F.col(f"places.{label}") for label in found])
    labels = F.array_sort(F.array_compact(F.array(
        *[F.when(F.size(F.col(f"places.{label}")) > 0, F.lit(label)) for label in found]
    )))
    return rows.select(
        "doc_id",
        "text_key",
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        labels.alias("base_labels"),
        "hits",
    )


def license_scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", notices=NOTICES) -> DataFrame:
    """One row per file: word count, base phrase places, labels of phrases and notices, and a score from 0 to 1."""
    spark = df.sparkSession
    table = postings_of(notices)
    words = sorted({row[0] for row in table} | {w for phrase, _ in PHRASES for w in phrase.split()})
    rows = stored(_slim(df, doc_id, text, words), "license-scan")
    postings = spark.sql(
        "SELECT * FROM VALUES "
        + ", ".join(f"('{w}', {t}, '{label}', {p}, {str(m).lower()})" for w, t, label, p, m in table)
        + " AS postings(word, template, label, template_position, mandatory)"
    )

    # Corpus statistics of the fixed vocabulary: at most one row per licence word.
    frequency = rows.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").count()
    weight = F.log(1 + F.lit(rows.count() + 1) / (F.coalesce("count", F.lit(0)) + 1))
    postings = (
        postings.join(F.broadcast(frequency), "word", "left")
        .select("word", "template", "label", "template_position", "mandatory", weight.alias("weight"))
    )
    by_rarity = Window.partitionBy("template").orderBy(F.desc("weight"), "template_position")
    whole = Window.partitionBy("template")
    postings = postings.select(
        "*",
        (F.row_number().over(by_rarity) <= ANCHORS).alias("anchor"),
        F.sum("weight").over(whole).alias("template_weight"),
        F.sum(F.col("mandatory").cast("int")).over(whole).alias("needed"),
    )

    votes = (
        rows.select("doc_id", "text_key", F.explode("hits").alias("hit"))
        .select("doc_id", "text_key", "hit.position", "hit.word")
        .join(F.broadcast(postings), "word")
        .withColumn("start", F.col("position") - F.col("template_position"))
        .drop("position", "word")
        .distinct()
    )
    aligned = (
        votes.groupBy("doc_id", "text_key", "template", "label", "start", "template_weight", "needed")
        .agg(
            F.sum("weight").alias("weight"),
            F.max("anchor").alias("proposed"),
            F.sum(F.col("mandatory").cast("int")).alias("found"),
        )
        .withColumn("share", F.col("weight") / F.col("template_weight"))
        .filter(F.col("proposed") & (F.col("share") >= MIN_SHARE) & (F.col("found") == F.col("needed")))
    )
    matches = aligned.groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share")
    )
    base, found = rows.drop("hits").alias("a"), matches.alias("b")
    joined = base.join(
        found, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")), "left"
    )
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    phrase = F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))
    return joined.select(
        "a.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.least(F.round(F.greatest(F.coalesce("share", F.lit(0.0)), phrase), 6), F.lit(1.0)).alias("score"),
    )


def _oracle() -> str:
    values = ", ".join(f"('{w}', {t}, '{label}', {p}, {int(m)})" for w, t, label, p, m in postings_of())
    phrases = " union all ".join(
        f"select doc_id, i - 1 as place, '{label}' as label from tokens where "
        + " and ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(phrase.split()))
        for phrase, label in PHRASES
    )
    return rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), tokens as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d
), places as ({phrases}
), base as (
  select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word,
         string_agg(distinct label, ',' order by label) as base_labels from places group by doc_id
), postings(word, template, label, tpos, mandatory) as (values {values}
), seen as (select doc_id, i - 1 as place, w[i] as word from tokens where w[i] in (select word from postings)
), frequency as (select word, count(distinct doc_id) as n from seen group by word
), weighted as (
  select p.*, ln(1 + ((select count(*) from documents) + 1) / (coalesce(n, 0) + 1)) as weight
  from postings p left join frequency f on p.word = f.word
), ranked as (
  select *, row_number() over (partition by template order by weight desc, tpos) <= {ANCHORS} as anchor,
         sum(weight) over (partition by template) as total, sum(mandatory) over (partition by template) as needed
  from weighted
), aligned as (
  select doc_id, template, label, place - tpos as start, sum(weight) / any_value(total) as share
  from seen join ranked on seen.word = ranked.word group by doc_id, template, label, place - tpos
  having bool_or(anchor) and sum(mandatory) = any_value(needed) and sum(weight) / any_value(total) >= {MIN_SHARE}
), found as (
  select doc_id, max(share) as share from aligned group by doc_id
), every as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels
  from (select doc_id, label from places union all select doc_id, label from aligned) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       least(round(greatest(coalesce(share, 0.0), case when n_base > 0 then {PHRASE_SCORE} else 0.0 end), 6), 1.0)::double as score
from d left join base using (doc_id) left join found using (doc_id) left join every using (doc_id)
"""


@query("op10_license_scan", _oracle())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return license_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
