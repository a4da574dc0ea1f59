"""Licence scan through a positional index of rare licence words, in DataFrame functions only.

1. Count in how many documents each word of the licence templates occurs.
2. Index, for every template, its rarest words by that count (highest IDF) with their places.
3. In each document look up the words that the index or a key phrase's rarest word holds, with their places.
4. Intersect: subtract a word's place in the template from its place in the document; hits that agree (within a slack) align.
5. Accept an alignment that has enough of the template's IDF weight and all its mandatory key phrases, word for word.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countersign.session import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a licence by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, notice in lower-case words, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license", "in compliance with the license")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
]
RARE = 6  # words of a template that the index holds
SLACK = 3  # words that may be put in or left out between hits
LEAST = 0.6  # share of a template's indexed IDF weight


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: `doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`.

    `n_base` counts all places of the base phrases; `first_word` and `last_word` are the smallest and largest of those places in
    words from 0, null without any. `score` is 1 with a base phrase, else the best accepted alignment's share, else 0. Null and empty
    texts have no words; null ids and repeated rows are rows like any other; no rows give none; other columns are not read.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    # One row per word of the templates and one for the number of rows.
    seen = F.array_union(F.array_intersect("words", _strings(vocabulary)), F.array(F.lit("")))
    df = {r["word"]: r["n"] for r in named.select(F.explode(seen).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = df.get("", 0)
    postings, weight = _index({w: df.get(w, 0) for w in vocabulary}, total)
    phrases = sorted({*PHRASES, *(p for _, _, keys in TEMPLATES for p in keys)})
    anchors = {p: min(enumerate(p.split()), key=lambda x: (df.get(x[1], 0), x[1])) for p in phrases}
    sought = sorted({w for _, w, _, _ in postings} | {w for _, w in anchors.values()})

    placed = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("word"))), lambda x: x["word"].isin(sought))
    none = F.array().cast("array<struct<pos:bigint,word:string>>")
    found = named.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", _strings(sought)), placed).otherwise(none).alias("hits")
    )
    starts = F.when(F.size("hits") == 0, F.array().cast("array<struct<phrase:string,start:bigint>>")).otherwise(F.flatten(F.array(*[_places(p, *anchors[p]) for p in phrases])))
    rows = checkpointed(found.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_words", "hits", starts.alias("places")))

    base = [p for p in PHRASES]
    label_of = F.create_map(*[F.lit(x) for p in base for x in (p, PHRASES[p])])
    in_base = F.filter("places", lambda x: x["phrase"].isin(base))
    rows_base = rows.select("row_id", "doc_id", "n_words", in_base.alias("base"))
    accepted = _aligned(rows, spark.createDataFrame(postings, "template int, word string, offset long, share double"))
    method = accepted.groupBy("row_id").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    base_set = F.array_distinct(F.transform("base", lambda x: label_of[x["phrase"]]))
    return rows_base.join(method, "row_id", "left").select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.round(F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))), 6).alias("score"),
    )


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _index(df: dict[str, int], total: int) -> tuple[list[tuple[int, str, int, float]], dict[str, float]]:
    """Postings (template, word, place, share of the template's weight) of each template's rarest words."""
    import math

    idf = {w: math.log((total + 1) / (n + 1)) + 1 for w, n in df.items()}
    out = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        rare = set(sorted(set(words), key=lambda w: (df[w], w))[:RARE])
        places = [(i, w) for i, w in enumerate(words) if w in rare]
        whole = sum(idf[w] for _, w in places)
        out += [(t, w, i, idf[w] / whole) for i, w in places]
    return out, idf


def _places(phrase: str, at: int, anchor: str) -> Column:
    """Where the phrase's words stand consecutively, found from its rarest word."""
    words = phrase.split()
    hit = F.filter("hits", lambda h: (h["word"] == anchor) & (h["pos"] >= at) & (F.slice("words", (h["pos"] - at + 1).cast("int"), len(words)) == _strings(words)))
    return F.transform(hit, lambda h: F.struct(F.lit(phrase).alias("phrase"), (h["pos"] - at).alias("start")))


def _aligned(rows: DataFrame, postings: DataFrame) -> DataFrame:
    """Accepted alignments: `row_id, label, share`."""
    hits = rows.select("row_id", F.inline("hits")).join(F.broadcast(postings), "word")  # a row per indexed word of the fixed templates
    starts = hits.groupBy("row_id", "template", (F.col("pos") - F.col("offset")).alias("start")).agg(F.sum("share").alias("share"))
    near = Window.partitionBy("row_id", "template").orderBy("start").rangeBetween(-SLACK, SLACK)
    enough = starts.withColumn("share", F.least(F.sum("share").over(near), F.lit(1.0))).where(F.col("share") >= LEAST)
    template = F.col("template")
    sizes = _strings_of([len(t.split()) for _, t, _ in TEMPLATES])
    enough = enough.withColumn("end", F.col("start") + sizes[template])
    keyed = [(t, p, len(keys)) for t, (_, _, keys) in enumerate(TEMPLATES) for p in keys]
    needs = rows.sparkSession.createDataFrame(keyed, "template int, phrase string, needed int")
    places = rows.select("row_id", F.inline("places")).withColumnRenamed("start", "place").join(F.broadcast(needs), "phrase")
    inside = (F.col("place") >= F.col("start") - SLACK) & (F.col("place") < F.col("end") + SLACK)
    proven = enough.join(places, ["row_id", "template"]).where(inside).groupBy("row_id", "template", "start", "share", "needed").agg(F.size(F.collect_set("phrase")).alias("have"))
    labels = _strings([label for label, _, _ in TEMPLATES])
    return proven.where("have = needed").select("row_id", labels[template].alias("label"), "share")


def _strings_of(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in values)


def license_sql() -> str:
    """The same scan as DuckDB SQL over `documents`."""
    words = _rows([(t, i, w) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())])
    templates = _rows([(t, label, len(text.split()), len(keys)) for t, (label, text, keys) in enumerate(TEMPLATES)])
    keys = _rows([(t, p) for t, (_, _, keys) in enumerate(TEMPLATES) for p in keys])
    phrases = sorted({*PHRASES, *(p for _, _, ks in TEMPLATES for p in ks)})
    phrase_words = _rows([(p, i, w) for p in phrases for i, w in enumerate(p.split())])
    base = _rows(list(PHRASES.items()))
    return f"""
with docs as (select row_number() over () as row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words from documents),
tw(t, o, w) as (values {words}), tp(t, label, size, needed) as (values {templates}), tk(t, phrase) as (values {keys}), pw(phrase, o, w) as (values {phrase_words}), bp(phrase, label) as (values {base}),
occ as (select row_id, unnest(words) as w, generate_subscripts(words, 1) - 1 as pos from docs),
used as (select * from occ where w in (select w from tw union select w from pw)),
n as (select count(*) as n from docs),
df as (select x.w, (select count(distinct row_id) from used u where u.w = x.w) as df from (select distinct w from tw) x),
rare as (select t, w, ln(((select n from n) + 1) / (df + 1)) + 1 as idf from (select t, w, df, row_number() over (partition by t order by df, w) as r from (select distinct t, w from tw) join df using (w)) where r <= {RARE}),
posts as (select t, w, o, idf / sum(idf) over (partition by t) as share from tw join rare using (t, w)),
starts as (select row_id, t, pos - o as start, sum(share) as share from used join posts using (w) group by 1, 2, 3),
near as (select row_id, t, start, least(sum(share) over (partition by row_id, t order by start range between {SLACK} preceding and {SLACK} following), 1.0) as share from starts),
places as (select row_id, phrase, pos - o as start from used join pw using (w) group by 1, 2, 3 having count(*) = (select count(*) from pw q where q.phrase = pw.phrase)),
proven as (select e.row_id, label, share from near e join tp using (t) join tk using (t) join places p on p.row_id = e.row_id and p.phrase = tk.phrase
 where share >= {LEAST} and p.start >= e.start - {SLACK} and p.start < e.start + size + {SLACK} group by e.row_id, e.t, label, e.start, share, needed having count(distinct p.phrase) = needed),
base as (select row_id, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as labels from places join bp using (phrase) group by 1),
method as (select row_id, list(distinct label) as labels, max(share) as share from proven group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
 coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') as labels,
 round(case when n_base > 0 then 1.0 else coalesce(share, 0.0) end, 6)::double as score
from docs left join base b using (row_id) left join method m using (row_id)"""
