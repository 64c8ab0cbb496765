"""License scans by a positional rare-token index over licence templates. DataFrame functions only.

Words are maximal runs of characters other than the ASCII controls, space and punctuation, A-Z in lower case. A template
has a label, its words, and a mandatory key phrase within them. A text is compared with the templates all of whose key
words it has. Of each, the SEEDS words of the highest inverse document frequency (counted over the whole corpus) that
the text has are looked up in both: a place in the text and a place in the template make an alignment. An alignment
counts if the key phrase stands word for word where it puts it and if NEED of the looked-up words (or all, if there are
fewer) stand at their template's places. Base phrases are templates that are all key phrase, so that none of their
places is missed. Work follows a text's words times the templates it may have, however often they repeat.
Null and empty texts have no words, no labels and score 0; null ids stay null; repeated rows are scanned as often as
they occur; places in texts of any length count, all of them; an empty table gives an empty result. score is the largest
share of a template's words that stand at their places in an alignment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: label, template, key phrase. The base phrases that the query counts come first.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: The operative wording of public licences, as words, each with the key phrase that no copy lacks.
TEMPLATES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "software distributed under the license is distributed on an as is basis"),
    ("artistic", "this package is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", "artistic license 2 0"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("cc", "this work is licensed under a creative commons attribution", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain by waiving"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license as published"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license terms and conditions for copying distribution and modification", "do what the fuck you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted to anyone to use this software for any purpose including commercial applications"),
)
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a template that are looked up in a text, and how many of them must agree on an alignment.
SEEDS, NEED = 4, 2


def words(text: Column) -> Column:
    found = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS)
    return F.filter(found, lambda w: w != "")


def vocabulary() -> list[str]:
    return sorted({w for _, t in BASE for w in t.split()} | {w for _, t, _ in TEMPLATES for w in t.split()})


def inverse_frequencies(worded: DataFrame, n_docs: int) -> dict[str, float]:
    """IDF of every licence word (a fixed vocabulary) over the whole corpus. worded: words."""
    own = F.array(*[F.lit(w) for w in vocabulary()])
    rows = worded.select(F.explode(F.array_intersect("words", own)).alias("w")).groupBy("w").count().collect()  # a row a licence word
    counts = {r["w"]: r["count"] for r in rows}
    return {w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) for w in vocabulary()}


def index(idf: dict[str, float]) -> list[dict]:
    """Templates: label, base, words, key phrase and its place, and the distinct words from the rarest to the most frequent."""
    out: list[dict] = []
    for label, text, phrase, base in [(x, t, t, True) for x, t in BASE] + [(*x, False) for x in TEMPLATES]:
        w, k = text.split(), phrase.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        # on equal frequencies a word that occurs once in its template, which gives one alignment a place, comes first
        out.append({"label": label, "base": base, "words": w, "key": k, "at": at, "rare": sorted(set(w), key=lambda x: (-idf[x], w.count(x), w.index(x)))})
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (template, first word, share of its words, base) of all verified templates, base_labels, labels, score."""
    d = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    templates = index(inverse_frequencies(d, d.count()))
    texts = lambda ws: F.array(*[F.lit(w) for w in ws])
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(x["label"]).alias("label"), F.lit(x["base"]).alias("base"), texts(x["words"]).alias("words"), texts(x["key"]).alias("key"), F.lit(x["at"]).alias("at"), texts(x["rare"]).alias("rare")) for i, x in enumerate(templates)])
    d = d.withColumn("own", F.array_intersect(texts(vocabulary()), "words"))
    able = F.filter(table, lambda t: F.size(F.array_except(t["key"], F.col("own"))) == 0)
    d = d.withColumn("able", F.when(F.size("own") > 1, able))

    def found(t: Column) -> Column:
        seeds = F.slice(F.filter(t["rare"], lambda w: F.array_contains("own", w)), 1, SEEDS)
        spots = F.filter(F.transform(t["words"], lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(seeds, x["w"]))
        at_of = F.flatten(F.transform(F.col("words"), lambda w, i: F.when(F.array_contains(seeds, w), F.transform(F.filter(spots, lambda x: x["w"] == w), lambda x: i - x["i"])).otherwise(F.array().cast("array<int>"))))
        there = lambda at, j: F.get(F.col("words"), at + j)
        verified = F.filter(F.array_distinct(at_of), lambda at: (at + t["at"] >= 0) & (F.slice(F.col("words"), F.greatest(at + t["at"], F.lit(0)) + 1, F.size(t["key"])) == t["key"]))
        agree = lambda at, xs: F.size(F.filter(xs, lambda x: (at + x["i"] >= 0) & (there(at, x["i"]) == x["w"])))
        enough = F.filter(verified, lambda at: agree(at, spots) >= F.least(F.lit(NEED), F.size(seeds)))
        share = lambda at: F.size(F.filter(F.transform(t["words"], lambda w, i: F.coalesce((at + i >= 0) & (there(at, i) == w), F.lit(False))), lambda same: same)) / F.size(t["words"])
        return F.transform(enough, lambda at: F.struct(t["t"].alias("t"), t["label"].alias("label"), at.alias("first_word"), share(at).alias("share"), t["base"].alias("base")))

    places = F.when(F.size("able") > 0, F.flatten(F.transform("able", found)))
    none = F.array().cast("array<struct<t:int,label:string,first_word:int,share:double,base:boolean>>")
    d = d.select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(places, none).alias("places"))
    named = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["label"]))), ",")
    return d.select(
        "doc_id", "n_words", "places", named(F.filter("places", lambda p: p["base"])).alias("base_labels"), named(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: licence labels of all documents."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["first_word"].cast("long"))
    out = out.withColumn("starts", starts)
    return out.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"), "base_labels", "labels", "score")
