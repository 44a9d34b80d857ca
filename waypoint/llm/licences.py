"""Licence scan with a positional index of rare words.

A template is a run of words with a label and a mandatory key phrase inside
it. The words' document frequencies over the whole corpus give their IDF; a
template is looked up by the rarest words of its key phrase only. Each place
of such a word in a file proposes the place where the template would start;
a start is looked at where the proposals of all of these words meet (their
postings are intersected by relative position). The label stands where the
key phrase is there word for word, and the score is the share of the
template's IDF that the words at their relative positions cover. Base phrases are templates that are their own key phrase, so all
of their places are found.

All of it is one projection over each file's word array: postings are looked
up with array functions, nothing is exploded, joined or shuffled but the
document frequencies (a row for each template word).

Defined cases: null texts count as empty and texts without a template have
empty labels, null places and score 0; repeated rows give repeated result
rows; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.llm.common import lower_ascii, others, table, text_or_empty


@dataclass(frozen=True)
class Template:
    """A label, the template's words, and the key phrase: words from ``at`` on, ``n`` of them."""

    label: str
    words: tuple[str, ...]
    at: int = 0
    n: int = 0
    base: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.at:self.at + (self.n or len(self.words))]


def template(label: str, text: str, key: str = "", base: bool = False) -> Template:
    words, k = tuple(text.split()), tuple((key or text).split())
    at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
    return Template(label, words, at, len(k), base)


#: The base phrases and their labels.
BASE = (
    template("cc-by", "cc by", base=True),
    template("gpl", "general public license", base=True),
    template("reserved", "all rights reserved", base=True),
)
#: Sentences and notices that licences are stated with, and the phrase that must be there word for word.
LICENCES = (
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("mit", "released under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             "permission is hereby granted free of charge"),
    template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    template("gpl-2.0", "licensed under the gnu general public license version 2",
             "gnu general public license version 2"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl-3.0", "gnu affero general public license version 3", "affero general public license"),
    template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    template("cc0-1.0", "creative commons zero v1 0 universal", "creative commons zero"),
    template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    # whole notices
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction including without "
             "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
             "software and to permit persons to whom the software is furnished to do so subject to the following "
             "conditions", "permission is hereby granted free of charge"),
    template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except "
             "in compliance with the license you may obtain a copy of the license at http www apache org licenses "
             "license 2 0", "apache license version 2 0"),
    template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the "
             "gnu general public license as published by the free software foundation either version 3 of the license "
             "or at your option any later version",
             "gnu general public license as published by the free software foundation either version 3"),
    template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the "
             "gnu general public license as published by the free software foundation either version 2 of the license "
             "or at your option any later version",
             "gnu general public license as published by the free software foundation either version 2"),
    template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             "mozilla public license v 2 0"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
             "permission to use copy modify and or distribute this software"),
)

#: Java form of the separators between words (all ASCII but digits and letters).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")


def document_frequencies(words: DataFrame, column: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each vocabulary word occurs (one row for each word reaches the driver)."""
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    got = (words.select(F.explode(F.array_intersect(F.col(column), vocab)).alias("w"))
           .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())
    return {r["w"]: r["n"] for r in got}


def rarest(words: tuple[str, ...], df: dict[str, int], count: int) -> list[int]:
    """Positions of the words of lowest document frequency, the first of equal ones."""
    return sorted(range(len(words)), key=lambda i: (df.get(words[i], 0), i))[:count]


def _postings(words: str, anchors: dict[str, list]) -> Column:
    """(i, w) of every place of an anchor word, in order."""
    listed = F.array(*[F.lit(w) for w in sorted(anchors)])
    return F.filter(F.transform(F.col(words), lambda w, i: F.when(
        F.array_contains(listed, w), F.struct(i.alias("i"), w.alias("w")))), lambda p: p.isNotNull())


def _starts(t: Template, anchor_positions: list[int], postings: str) -> Column:
    """Places where the template may start: those that the postings of all of its rare words propose."""
    def proposed(a: int) -> Column:
        return F.transform(F.filter(F.col(postings), lambda p: p["w"] == t.words[a]), lambda p: p["i"] - a)

    return reduce(F.array_intersect, map(proposed, anchor_positions[1:]), F.array_distinct(proposed(anchor_positions[0])))


def _there(words: str, start: Column, phrase: tuple[str, ...], at: int) -> Column:
    """Whether the phrase stands at ``start + at`` word for word."""
    first = start + F.lit(at)
    return (first >= 0) & (F.slice(F.col(words), F.greatest(first, F.lit(0)) + 1, len(phrase))
                           == F.array(*[F.lit(w) for w in phrase]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = LICENCES, base: tuple[Template, ...] = BASE,
         rare: int = 2, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, base_places (sorted word positions),
    base_labels, labels (sorted arrays) and score.

    ``rare``: how many of a template's rarest words must propose a start together. A template
    is found where its key phrase stands; its score is the share of its IDF
    found at the right relative positions there.
    """
    every = (*base, *templates)
    vocabulary = sorted({w for t in every for w in t.words})
    passed = others(docs, text, "n_words", "base_places", "base_labels", "labels", "score")
    worded = docs.select(*passed, words_of(text_or_empty(text)).alias("__w"))
    df = document_frequencies(worded.select("__w"), "__w", vocabulary)
    total = worded.count()
    idf = {w: log(1 + total / (1 + df.get(w, 0))) for w in vocabulary}

    # base phrases need one sure word; a template's rare words are those of its key phrase,
    # which must be there anyway
    looked = {t: ([t.at + i for i in rarest(t.key, df, 1)] if t.base
                  else [t.at + i for i in rarest(t.key, df, rare)]) for t in every}
    anchors = {t.words[i]: [] for t in every for i in looked[t]}
    out = worded.withColumn("__p", _postings("__w", anchors))

    def places(t: Template) -> Column:
        return F.filter(_starts(t, looked[t], "__p"), lambda s: _there("__w", s, t.key, t.at))

    def coverage(t: Template) -> Column:
        whole = reduce(add, [idf[w] for w in t.words])  # left to right, as the columns are added
        covered = lambda s: sum(
            (F.when((s + i >= 0) & (F.get(F.col("__w"), s + i) == w), idf[w]).otherwise(0.0)
             for i, w in enumerate(t.words)), F.lit(0.0)) / F.lit(whole)
        return F.coalesce(F.array_max(F.transform(places(t), covered)), F.lit(0.0))

    none = F.array().cast("array<string>")
    label = lambda t, found: F.when(found, F.array(F.lit(t.label))).otherwise(none)
    # files without any rare word skip the look-ups
    hit = F.size("__p") > 0
    found = out.withColumn("__base", F.when(hit, F.struct(*[places(t).alias(f"b{i}") for i, t in enumerate(base)])))
    found = found.withColumn("__cov", F.when(hit, F.array(*[coverage(t) for t in templates])))
    places_ = F.array_sort(F.concat(*[F.col(f"__base.b{i}") for i in range(len(base))]))
    base_labels = F.concat(*[label(t, F.size(F.col(f"__base.b{i}")) > 0) for i, t in enumerate(base)])
    own = F.concat(*[label(t, F.col("__cov")[i] > 0) for i, t in enumerate(templates)])
    some = F.coalesce(F.size(places_), F.lit(0)) > 0
    return found.select(
        *passed, F.size("__w").cast("long").alias("n_words"),
        F.coalesce(places_, F.array().cast("array<int>")).alias("base_places"),
        F.when(hit, F.array_sort(F.array_distinct(base_labels))).otherwise(none).alias("base_labels"),
        F.when(hit, F.array_sort(F.array_distinct(F.concat(base_labels, own)))).otherwise(none).alias("labels"),
        F.when(hit, F.greatest(F.array_max("__cov"), F.when(some, F.lit(0.5)).otherwise(0.0)))
        .otherwise(0.0).alias("score"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and places of base phrases in every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").cast("long").alias("first_word"),
        F.array_max("base_places").cast("long").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"), "score")


def _sql() -> str:
    """The same by looking at every position of every file."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    every = (*BASE, *LICENCES)
    vocabulary = sorted({w for t in every for w in t.words})
    at = lambda t: (f"list_filter(range(len(w)::BIGINT), lambda i: w[i + 1:i + {len(t.key)}] = {quoted(t.key)})")
    idf = lambda w: f"m['{w}']"

    def coverage(t: Template, places: str) -> str:
        whole = " + ".join(["0", *map(idf, t.words)])
        found = " + ".join(["0.0::DOUBLE", *(
            f"CASE WHEN s - {t.at} + {i} >= 0 AND w[s - {t.at} + {i} + 1] = '{x}' THEN {idf(x)} ELSE 0 END"
            for i, x in enumerate(t.words))])
        return f"coalesce(list_max(list_transform({places}, lambda s: ({found}) / ({whole}))), 0.0)"

    labels = lambda items: ("array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(
        f"CASE WHEN len({p}) > 0 THEN '{t.label}' END" for t, p in items) + "], lambda x: x IS NOT NULL))), ',')")
    base = [(t, f"b{i}") for i, t in enumerate(BASE)]
    own = [(t, f"t{i}") for i, t in enumerate(LICENCES)]
    return f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
df AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS word FROM d) GROUP BY word),
idf AS (
  SELECT v.word, ln(1 + (SELECT count(*) FROM d) / (1 + coalesce(df.n, 0))::DOUBLE) AS idf
  FROM (SELECT unnest({quoted(vocabulary)}) AS word) v LEFT JOIN df ON df.word = v.word),
p AS (SELECT doc_id, w, {", ".join(f"{at(t)} AS {c}" for t, c in base + own)} FROM d),
q AS (SELECT *, list_concat(list_concat(b0, b1), b2) AS places
  FROM p, (SELECT map_from_entries(list(struct_pack(k := word, v := idf))) AS m FROM idf))
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(places) AS first_word, list_max(places) AS last_word,
  {labels(base)} AS base_labels, {labels(base + own)} AS labels,
  greatest(CASE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0 END,
    {", ".join(coverage(t, c) for t, c in own)}) AS score
FROM q"""


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP6_SQL = _sql()
