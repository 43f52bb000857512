"""Licence scan: a positional index of rare licence words, with DataFrame functions only.

Templates are short licence passages. A document is reduced to its hits: (position, word) for words of
the templates' vocabulary. Each template's words of highest IDF are indexed with their postings (template, position
in the template), so many of them that no alignment of share `min_share` can have fewer than `min_agree` of them, and
every hit of such a word votes. Postings that agree on the relative position make a candidate, whose share of the
template's IDF is then summed over all hits at that alignment, and whose mandatory key phrase must stand in
the text, word by word. Only hits leave the scan of the texts, never the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import materialize

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, passage, mandatory phrase): well-known sentences of public licences, as words.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]
#: Words too common to index; they only count where a key phrase is verified.
STOP = frozenset("the of is in to a and or it this that you not may with at for any as be an are if into under from".split())
RARE_WORDS, MIN_AGREE, MIN_SHARE = 6, 2, 0.6

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def licence_words(text):
    """Column: words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased (null: none)."""
    parts = F.split(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " "), " ")
    return F.filter(parts, lambda w: w != "")


def _phrase_starts(hits, phrase: str):
    """Column: positions where the phrase stands, from the hits in order of position; each of its words is among the words that hit."""
    words = phrase.split()

    def here(k):
        at = F.get(hits, k)
        same = at["w"] == words[0]
        for step, word in enumerate(words[1:], 1):
            nxt = F.get(hits, k + step)
            same = same & (nxt["w"] == word) & (nxt["i"] == at["i"] + step)
        return F.coalesce(same, F.lit(False))

    # no hit: an empty array, where sequence() would count down
    index = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(index, here), lambda k: F.get(hits, k)["i"])


def rare_postings(places: list[tuple[int, str, float]], least: int, min_agree: int, min_share: float) -> set[str]:
    """The words of highest IDF of a template's (position, word, idf): `least` at least, and more until none can be missed.

    An alignment with fewer than min_agree of them has at most the IDF of all other places and of the min_agree - 1 highest.
    """
    ranked = sorted({(v, w) for _, w, v in places}, reverse=True)
    total = sum(v for _, _, v in places)
    missed = sum(sorted((v for _, _, v in places), reverse=True)[: min_agree - 1])
    chosen: set[str] = set()
    for _, word in ranked:
        left = sum(v for _, w, v in places if w not in chosen)
        if len(chosen) >= least and left + missed < (min_share - 1e-6) * total:
            break
        chosen.add(word)
    return chosen


def scan_licences(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, rare_words: int = RARE_WORDS, min_agree: int = MIN_AGREE, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs(doc_id, text).

    n_base counts all places of the base phrases; first_word and last_word are their smallest and largest start
    (null without any). base_labels and labels are distinct, sorted, joined by commas (empty string: none).
    score is the largest share of a template's IDF found at one alignment, of the templates that get a label, 0 without any; a label needs a share of
    min_share, min_agree words at that alignment and the whole key phrase, whatever else the text holds. Of alignments that tie
    any gives the same share. Null and empty texts
    have no words; texts of any length are read whole. An empty table gives no rows. Rows are kept apart even if doc_ids repeat or are null; other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, passage, phrase in templates for w in f"{passage} {phrase}".split() if w not in STOP} | {w for p in BASE for w in p.split()})
    # a base phrase or a key phrase holds one of these, so a text without any has no label and needs no hits
    strong = sorted({next(w for w in sorted(p.split(), key=len, reverse=True) if w not in STOP) for p in [*BASE, *(t[2] for t in templates)]} | {"license", "cc"})
    told = sorted({*vocabulary, *(w for t in templates for w in t[2].split())})
    found = F.transform(F.col("__words"), lambda w, i: F.when(w.isin(told), F.struct(i.alias("i"), w.alias("w"))))
    none = F.array().cast("array<struct<i:int,w:string>>")
    words = F.array(*[F.lit(w) for w in vocabulary])
    hits = materialize(
        docs.select("doc_id", licence_words(F.col("text")).alias("__words")).select(
            "doc_id", F.monotonically_increasing_id().alias("__row"), F.size("__words").cast("long").alias("n_words"),
            F.array_intersect("__words", words).alias("__has"),
            F.when(F.arrays_overlap("__words", F.array(*[F.lit(w) for w in strong])), F.array_compact(found)).otherwise(none).alias("__hits"),
        ),
        "licence-hits",
    )

    # IDF of the vocabulary over all documents: one row per template word, bounded by the templates
    frequency = {r["w"]: r["n"] for r in hits.select(F.explode("__has").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs = hits.count()
    idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    postings, totals, mandatory = [], [], []
    for t, (label, passage, phrase) in enumerate(templates):
        words = passage.split()
        places = [(p, w, idf[w]) for p, w in enumerate(words) if w not in STOP]
        rare = rare_postings(places, rare_words, min_agree, min_share)
        postings += [(t, p, w, v, w in rare) for p, w, v in places]
        totals.append((t, label, sum(idf[w] for w in words if w not in STOP)))
        mandatory.append(phrase)
    # constants of the templates, so their size is fixed by the code
    index = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({t}, {p}, '{w}', {v!r}D, {rare})" for t, p, w, v, rare in postings) + " AS x(t, p, w, idf, rare)")
    labels = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({t}, '{label}', {v!r}D)" for t, label, v in totals) + " AS x(t, label, total)")

    # every hit of a template's rare words votes for that template
    some = hits.where(F.size("__hits") > 0)
    each = some.select("__row", F.explode(F.filter("__hits", lambda h: h["w"].isin(vocabulary))).alias("h")).select("__row", F.col("h.i").alias("i"), F.col("h.w").alias("w"))
    votes = each.join(F.broadcast(index.where("rare")), "w").groupBy("__row", "t", (F.col("i") - F.col("p")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    candidates = votes.where(F.col("n") >= min_agree).select("__row", "t", "at")
    aligned = each.join(F.broadcast(index), "w").select("__row", "t", (F.col("i") - F.col("p")).alias("at"), "idf")
    shares = candidates.join(aligned, ["__row", "t", "at"]).groupBy("__row", "t", "at").agg(F.sum("idf").alias("s"))
    best = shares.groupBy("__row", "t").agg(F.max("s").alias("s"))
    best = best.join(F.broadcast(labels), "t").select("__row", "t", "label", F.least(F.lit(1.0), F.round(F.col("s") / F.col("total"), 9)).alias("share"))
    per = best.groupBy("__row").agg(F.collect_list(F.struct("t", "label", "share")).alias("__best"))  # a row per template at most

    joined = hits.join(per, "__row", "left")
    starts = [_phrase_starts(F.col("__hits"), p) for p in BASE]
    joined = joined.withColumns({f"__at{k}": s for k, s in enumerate(starts)})
    all_starts = F.concat(*[f"__at{k}" for k in range(len(BASE))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"__at{k}") > 0, F.lit(v)) for k, v in enumerate(BASE.values())]))
    has_phrase = F.array(*[F.size(_phrase_starts(F.col("__hits"), p)) > 0 for p in mandatory])
    own = F.filter(F.coalesce("__best", F.array().cast("array<struct<t:int,label:string,share:double>>")), lambda b: (b["share"] >= min_share) & F.get(F.col("__phrases"), b["t"]))
    joined = joined.withColumns({"__all": all_starts, "__base": base_labels, "__phrases": F.when(F.col("__best").isNotNull(), has_phrase)}).withColumn("__own", own)
    return joined.select(
        "doc_id", "n_words", F.size("__all").cast("long").alias("n_base"),
        F.array_min("__all").cast("long").alias("first_word"), F.array_max("__all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("__base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("__base", F.transform("__own", lambda b: b["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("__own", lambda b: b["share"])), F.lit(0.0)).alias("score"),
    )
