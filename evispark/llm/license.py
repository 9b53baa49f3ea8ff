"""Licences in files: a positional index of rare licence words, read with DataFrame functions only.

What is looked for is an entry: a key phrase, each word of which must stand, or the text of a licence, of
which all but a share may. The rarest words of an entry, by inverse document frequency over all files, are
its postings: (word, entry, place). A file's words are looked up in them, and each hit says where the
entry would start. Starts on which two postings agree are verified: a phrase word by word, a text by the
share of its words that stand at their places, among them half of its key phrase. A text has as many
postings as may be missing, and two more, so none that would be verified lacks two that agree.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (label, phrase), which define the base. Such a phrase is a template of its own.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Fixed values: (label, key phrase, text of the licence or of the notice that stands for it in a file).
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "gpl",
        "gnu general public license",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
    (
        "lgpl",
        "gnu lesser general public license",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ),
    (
        "mpl-2",
        "mozilla public license version 2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, Version 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "cc-by",
        "creative commons attribution 4",
        """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    ),
)
#: Postings that must agree on a start. The share of a text's words that must stand at their places, in per cent.
ANCHORS, LEAST_PERCENT = 2, 80
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII characters that are in no word.
_BREAKS = "".join(chr(c) for c in range(0x80) if not re.match("[0-9A-Za-z]", chr(c)))


def words_of(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case; null has none."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _BREAKS, _LOWER + " " * len(_BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def template_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[0-9a-z]+", text.lower()))


def _strings(words) -> Column:
    return F.array(*map(F.lit, words))


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many files each word of the vocabulary stands, over all files; as many rows as the vocabulary has words."""
    wanted = _strings(vocabulary)
    seen = files.select(F.explode(F.array_intersect(words_of(F.col("text")), wanted)).alias("word"))
    return {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}


def _idf(words: set[str], frequency: dict[str, int], n_files: int) -> dict[str, float]:
    return {w: math.log((1 + n_files) / (1 + frequency.get(w, 0))) + 1e-9 for w in words}


def all_templates(added: tuple[tuple[str, str, str], ...] = TEMPLATES) -> list[tuple[str, tuple[str, ...], tuple[str, ...], int, bool]]:
    """(label, key phrase, words of the template, place of the phrase in it, base)."""
    out = [(label, p, p, 0, True) for label, p in ((label, template_words(phrase)) for label, phrase in BASE_PHRASES)]
    for label, phrase, text in added:
        p, t = template_words(phrase), template_words(text)
        out.append((label, p, t, next(i for i in range(len(t)) if t[i : i + len(p)] == p), False))
    return out


def _entries(added: tuple[tuple[str, str, str], ...]) -> list[dict]:
    """Phrases, of which all words must stand, and texts, of which most must: words, their label, the text and the phrase's place in it."""
    out = []
    for label, phrase, text, at, base in all_templates(added):
        of = {"label": label, "base": base, "at": at, "n": len(phrase), "text": list(text)}
        out.append(of | {"words": list(phrase), "whole": True})
        if not base:
            out.append(of | {"words": list(text), "whole": False})
    return out


def _postings(entries: list[dict], idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Of each rare word the entries (their numbers) it is in and its places there."""
    out: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for number, e in enumerate(entries):
        missing = 0 if e["whole"] else len(e["words"]) * (100 - LEAST_PERCENT) // 100
        for place in sorted(range(len(e["words"])), key=lambda i: (-idf[e["words"][i]], i))[: ANCHORS + missing]:  # noqa: B023
            out[e["words"][place]].append((number, place))
    return dict(sorted(out.items()))


def find_licenses(files: DataFrame, added: tuple[tuple[str, str, str], ...] = TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of files: id, n_words and hits (start of the key phrase in words, label, n words of it, base, share of the text found).

    Every place of every key phrase is a hit, and every place at which LEAST_PERCENT of a licence's words
    and half of its key phrase stand; hits are in order of start, then label. A null or empty text has
    none, an empty table no rows; repeated rows get equal results; other columns are not read. A text is
    one array of words, however long. Nothing is shuffled but the vocabulary's counts.
    """
    entries = _entries(added)
    vocabulary = sorted({w for e in entries for w in e["words"]})
    postings = _postings(entries, _idf(set(vocabulary), document_frequencies(files, vocabulary), files.count()))
    whole = lambda x: F.lit(x).cast("int")
    index = F.create_map(*(c for w, own in postings.items() for c in (F.lit(w), F.array(*(F.struct(whole(e).alias("entry"), whole(k).alias("place")) for e, k in own)))))
    known = F.array(*(F.struct(F.lit(e["label"]).alias("label"), F.lit(e["base"]).alias("base"), F.lit(e["whole"]).alias("whole"), whole(e["at"]).alias("at"), whole(e["n"]).alias("n"), _strings(e["text"]).alias("text")) for e in entries))
    rare = list(postings)
    words = files.select(F.col(id_col), words_of(F.col("text")).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("place"), w.alias("word")))), lambda x: x.isNotNull())
    found = words.select(id_col, "words", F.when(F.arrays_overlap("words", _strings(rare)), places).alias("places"))
    starts = F.flatten(F.transform("places", lambda x: F.transform(F.element_at(index, x["word"]), lambda q: F.struct(q["entry"].alias("entry"), (x["place"] - q["place"]).alias("start")))))
    found = found.select(id_col, "words", F.array_sort(starts).alias("starts"))
    before = lambda i, n: F.get("starts", i - n)
    agreed = F.filter("starts", lambda x, i: (i > 0) & x.eqNullSafe(before(i, 1)) & ~x.eqNullSafe(before(i, 2)))

    def verified(words: Column, x: Column) -> Column:
        """The hit of an entry at a start, or null."""
        e = F.element_at(known, x["entry"] + 1)
        text, phrase = x["start"] - F.when(e["whole"], e["at"]).otherwise(0), x["start"] + F.when(e["whole"], 0).otherwise(e["at"])
        stands = F.transform(e["text"], lambda w, k: F.coalesce((text + k >= 0) & (w == F.get(words, F.greatest(text + k, F.lit(0)))), F.lit(False)))
        in_phrase = F.size(F.filter(F.slice(stands, e["at"] + 1, e["n"]), lambda b: b))
        n_text, n_stand = F.size(e["text"]), F.size(F.filter(stands, lambda b: b))
        holds = F.when(e["whole"], in_phrase == e["n"]).otherwise((100 * n_stand >= LEAST_PERCENT * n_text) & (2 * in_phrase >= e["n"]))
        return F.when(holds, F.struct(F.greatest(phrase, F.lit(0)).cast("long").alias("start"), e["label"].alias("label"), e["n"].alias("n"), e["base"].alias("base"), (n_stand / n_text.cast("double")).alias("share")))

    found = found.select(id_col, "words", agreed.alias("agreed"))
    hits = F.array_sort(F.array_distinct(F.array_compact(F.transform("agreed", lambda x: verified(F.col("words"), x)))))
    none = F.array().cast("array<struct<start:bigint,label:string,n:int,base:boolean,share:double>>")
    return found.select(id_col, F.size("words").cast("long").alias("n_words"), F.coalesce(hits, none).alias("hits"))


def digest_columns(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score (the largest share of a template that was found, a base phrase being one; 0 for none)."""
    found = find_licenses(files, id_col=id_col).withColumn("in_base", F.filter("hits", lambda h: h["base"]))
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return found.select(
        id_col,
        "n_words",
        F.size("in_base").cast("long").alias("n_base"),
        F.try_element_at("in_base", F.lit(1))["start"].alias("first_word"),
        F.try_element_at("in_base", F.lit(-1))["start"].alias("last_word"),
        labels("in_base").alias("base_labels"),
        labels("hits").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )
