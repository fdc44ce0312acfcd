"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is 256 consecutive words; blocks start every 128 words, so any stretch of up to 128 words lies whole in one. A
block meets a template if a stretch of it, no longer than the template and a quarter more, holds at least `threshold` of
the template's distinct words and all of its key words; a template of up to 8 words has to stand there whole, in any
order. Words are ordered by their count over all documents, rarest first. The join shuffles nothing but results: blocks
are matched with the templates' prefixes (a broadcast table as large as the template list, which is a constant of the
program):

* prefix filter: two sets that share `need` words share one among the first size - need + 1 of each;
* length filter: a block with fewer than `need` template words can't meet;
* positional filter: after the first common word, at most min(rest of template, rest of block) more can follow;
* then the full overlap is counted, and the stretches of the few blocks that are left are searched.

Of a family of templates that nearly contain each other (licenses with and without a clause), those with the most words
found label a block. A match is one of word sets: a stretch that holds a notice's words in another order meets it, too.
Words outside all templates can't be shared, so blocks are reduced to template words first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label, family, key words and text, from the public notices of the licenses.
NOTICES = [
    ("agpl", "gnu", "affero", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "", "apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "", "redistributions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by", "cc", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "", "", "CC BY 4.0"),
    ("cc-by-nc", "cc", "attribution noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "", "", "CC BY-NC 4.0"),
    ("cc-by-nc-sa", "cc", "attribution noncommercial sharealike", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-sa", "", "", "CC BY-NC-SA 4.0"),
    ("cc-by-nd", "cc", "attribution noderivatives", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "", "", "CC BY-ND 4.0"),
    ("cc-by-sa", "cc", "attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "", "", "CC BY-SA 4.0"),
    ("gpl", "gnu", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "", "gnu", "GNU General Public License, version 2"),
    ("gpl", "", "gnu", "GNU General Public License, version 3"),
    ("isc", "", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu", "lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "", "", "Released under the MIT License"),
    ("mit", "", "", "SPDX-License-Identifier: MIT"),
    ("mit", "", "granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl", "", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "", "", "All rights reserved"),
    ("proprietary", "", "reproduced", "No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("unlicense", "", "unencumbered", "This is free and unencumbered software released into the public domain"),
]
# Label and phrase of the base; every place where a phrase's words stand in a row counts.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE, BLOCK = 128, 256
THRESHOLD = 0.8
#: Templates of up to so many words have to stand there whole.
SHORT = 8


def words_of(text: Column) -> Column:
    """A-Z lower-cased; words are runs of other characters than ASCII signs, controls and spaces; null is empty."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


def _split(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def templates(threshold: float = THRESHOLD) -> list[dict]:
    """Templates as word sets: how many words a stretch of `reach` words needs, and which at any rate."""
    out = []
    for label, family, key, text in NOTICES:
        w = _split(text)
        words, short = sorted(set(w)), len(w) <= SHORT
        need = len(words) if short else math.ceil(threshold * len(words) - 1e-9)
        out.append({"label": label, "family": family or text, "words": words, "key": key.split(), "need": need, "reach": len(w) if short else math.ceil(1.25 * len(w)), "phrase": []})
    for label, text in PHRASES:
        w = _split(text)
        out.append({"label": label, "family": text, "words": sorted(set(w)), "key": [], "need": len(set(w)), "reach": len(w), "phrase": w})
    if max(t["reach"] for t in out) > STRIDE:
        raise ValueError(f"stretches of more than {STRIDE} words don't lie whole in a block")
    return out


def _ranks(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words, rarest over all documents first (at most as many rows as template words reach the driver)."""
    found = docs.select(F.explode(words_of(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary))
    count = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document (doc_id and text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start (null if
    none); labels has those of the base and of all templates met; score is the largest share of a template's words found
    in one stretch, 0 where no template is met. Null and empty texts give zero words. Rows alike in doc_id and text give
    as many equal rows; null doc_ids stay; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    temps = templates(threshold)
    order = _ranks(docs, sorted({w for t in temps for w in t["words"]}))
    rank = {w: i + 1 for i, w in enumerate(order)}
    index = []
    for k, t in enumerate(temps):
        ids = sorted(rank[w] for w in t["words"])
        rest = (k, t["label"], t["family"], ids, [rank[w] for w in t["key"]], t["need"], t["reach"], [rank[w] for w in t["phrase"]])
        index += [(r, i, *rest) for i, r in enumerate(ids[: len(ids) - t["need"] + 1])]
    table = spark.createDataFrame(index, "token int, i int, template int, label string, family string, ids array<int>, key array<int>, need int, reach int, phrase array<int>")
    prefix = sorted({order[x[0] - 1] for x in index})
    least = min(t["need"] for t in temps)
    base = docs.select("doc_id", F.xxhash64("text").alias("rk"), words_of(F.col("text")).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / STRIDE).cast("int")), lambda k: F.struct(k.alias("k"), F.slice("w", k * STRIDE + 1, BLOCK).alias("w")))
    cut = F.filter(cut, lambda b: F.exists(b["w"], lambda w: w.isin(prefix)))
    blocks = base.select("doc_id", "rk", F.size("w").alias("n_words"), F.explode_outer(F.when(F.exists("w", lambda w: w.isin(prefix)), cut)).alias("b"))
    # words as ranks, 0 outside the templates; the commonest are looked up first
    common = F.array(*[F.lit(w) for w in reversed(order)])
    ranks = F.transform("b.w", lambda w: F.when(w.isin(order), len(order) + 1 - F.array_position(common, w)).otherwise(0).cast("int"))
    blocks = blocks.select("doc_id", "rk", "n_words", F.col("b.k").alias("k"), ranks.alias("r"))
    blocks = blocks.withColumn("set", F.array_sort(F.array_distinct(F.filter("r", lambda x: x > 0))))
    heads = F.when(F.size("set") >= least, F.slice("set", F.lit(1), F.greatest(F.size("set") - least + 1, F.lit(1))))
    probe = blocks.select("*", F.posexplode_outer(heads).alias("j", "token"))
    size, whole = F.size("set"), F.size("ids")
    first = F.size(F.array_intersect(F.slice("set", F.lit(1), F.col("j")), F.col("ids"))) == 0
    may = (size >= F.col("need")) & (F.col("j") <= size - F.col("need")) & (1 + F.least(whole - F.col("i") - 1, size - F.col("j") - 1) >= F.col("need")) & first
    met = probe.join(F.broadcast(table), "token", "left")  # as many rows as the template list has prefix words
    ok = F.when(may, F.size(F.array_intersect("set", "ids")) >= F.col("need")).otherwise(False)
    met = met.withColumn("ok", F.coalesce(ok, F.lit(False)))
    starts = F.filter(F.sequence(F.lit(0), F.size("r") - 1), lambda p: F.array_contains(F.col("ids"), F.get("r", p)))

    def words_at(p: Column) -> Column:
        some = F.array_intersect(F.slice("r", p + 1, F.col("reach")), F.col("ids"))
        return F.when(F.size(F.array_except("key", some)) == 0, F.size(some)).otherwise(0)

    at = lambda p: F.forall(F.sequence(F.lit(0), F.size("phrase") - 1), lambda q: F.get("r", p + q) == F.get("phrase", q))
    in_row = F.size("phrase") > 0
    places = F.when(F.col("ok") & in_row, F.filter(F.sequence(F.lit(0), F.least(F.lit(STRIDE), F.size("r")) - 1), lambda p: F.coalesce(at(p), F.lit(False))))
    met = met.withColumn("places", places).withColumn("found", F.when(F.col("ok"), F.when(in_row, F.when(F.size("places") > 0, whole)).otherwise(F.array_max(F.transform(starts, words_at)))))
    hit = F.struct("family", "found", "label", in_row.alias("base"), (F.col("found") / whole).alias("share"), "places")
    # at most as many hits a block as there are templates; equal rows give equal hits
    hits = met.groupBy("doc_id", "rk", "k").agg(F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("found") >= F.col("need"), hit)).alias("hits"))
    best = F.filter("hits", lambda h: ~F.exists("hits", lambda o: (o["family"] == h["family"]) & (o["found"] > h["found"])))
    hits = hits.withColumn("hits", best)
    spots = F.flatten(F.transform(F.filter("hits", lambda h: h["base"]), lambda h: h["places"]))
    start = F.col("k") * STRIDE
    out = hits.select(
        "doc_id", "rk", "n_words", F.lit(0).alias("copies"), F.size(spots).alias("n_base"), (start + F.array_min(spots)).alias("first_word"), (start + F.array_max(spots)).alias("last_word"),
        F.array_distinct(F.transform(F.filter("hits", lambda h: h["base"]), lambda h: h["label"])).alias("base"), F.array_distinct(F.transform("hits", lambda h: h["label"])).alias("all"), F.array_max(F.transform("hits", lambda h: h["share"])).alias("share"),
    )
    none = F.lit(None)
    rows = docs.select("doc_id", F.xxhash64("text").alias("rk"), none.cast("int").alias("n_words"), F.lit(1).alias("copies"), F.lit(0).alias("n_base"), none.cast("int").alias("first_word"), none.cast("int").alias("last_word"), none.cast("array<string>").alias("base"), none.cast("array<string>").alias("all"), none.cast("double").alias("share"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",")
    out = out.unionByName(rows).groupBy("doc_id", "rk").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("n_base").cast("long").alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"),
        F.max("last_word").cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("all").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sum("copies").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("rk", "copies", "copy")


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL that searches every stretch of every block for every notice, from the notices' plain texts."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({quoted(label)}, {quoted(family or text)}, {quoted(key)}, {quoted(text)}, false)" for label, family, key, text in NOTICES)
    rows += ",\n  " + ",\n  ".join(f"({quoted(label)}, {quoted(text)}, '', {quoted(text)}, true)" for label, text in PHRASES)
    cut = lambda c: rf"list_filter(regexp_split_to_array(translate({c}, '{UPPER}', '{LOWER}'), '{BREAK}'), lambda w: w <> '')"
    return rf"""
with d as (select row_number() over () as i, doc_id, {cut("coalesce(text, '')")} as w from documents),
b as (select i, k * {STRIDE} as start, w[k * {STRIDE} + 1 : k * {STRIDE} + {BLOCK}] as w from (select i, w, unnest(range(0, (len(w) - 1) // {STRIDE} + 1)) as k from d where len(w) > 0)),
n(label, family, keys, notice, base) as (values
  {rows}),
t as (select label, family, base, list_filter(string_split(keys, ' '), lambda w: w <> '') as keys, {cut("notice")} as words from n),
u as (select *, list_distinct(words) as uniq, len(list_distinct(words)) as size, case when len(words) <= {SHORT} then len(words) else ceil(1.25 * len(words)) end::bigint as reach,
  case when len(words) <= {SHORT} then len(list_distinct(words)) else ceil({threshold} * len(list_distinct(words)) - 1e-9) end as need from t),
c as (select i, start, w, u.* from b, u where len(list_intersect(w, uniq)) >= need),
m as (select *, case when base then list_filter(range(0, least({STRIDE}, len(w))), lambda p: w[p + 1 : p + len(words)] = words) else [] end as places,
  case when base then 0 else list_max(list_transform(range(0, len(w)), lambda p: case when list_has_all(w[p + 1 : p + reach], keys) then len(list_intersect(w[p + 1 : p + reach], uniq)) else 0 end)) end as best from c),
f as (select *, case when base then case when len(places) > 0 then size else 0 end else best end as found from m),
h as (select * from (select *, max(found) over (partition by i, start, family) as most from f where found >= need) where found = most),
g as (select i, sum(len(places)) as n_base, min(case when base then start + list_min(places) end) as first_word, max(case when base then start + list_max(places) end) as last_word,
  array_to_string(list_sort(list(distinct label) filter (base)), ',') as base_labels, array_to_string(list_sort(list(distinct label)), ',') as labels, max(found / size) as score from h group by i)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join g using (i)
"""
