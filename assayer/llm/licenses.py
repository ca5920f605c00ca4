"""Licence scan by a positional index of rare words; DataFrame functions only.

The words of all licence notices are ranked once by how few documents hold them. A notice that stands in a file agrees with it in at
least ``AGREE`` of its words at one beginning; then some of its rarest words agree there too, so only these are looked up. Their
places in the file less their places in the notice vote for beginnings; a beginning with enough votes is compared word by word, and
a mandatory phrase has to stand in the stretch. What is verified gives a label and its score, the share of agreeing words.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing; a word of the contract
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}  # fixed values of the contract

# Label, notice, mandatory phrases (any of them), all in the words of LICENCE_WORD.
NOTICES = [
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0 creative commons attribution noncommercial 4 0 international license", ["cc by nc", "creative commons attribution noncommercial"]),
    ("cc-by-nd", "licensed under cc by nd 4 0 creative commons attribution noderivatives 4 0 international license", ["cc by nd", "creative commons attribution noderivatives"]),
    ("cc-by-sa", "licensed under cc by sa 4 0 creative commons attribution sharealike 4 0 international license", ["cc by sa", "creative commons attribution sharealike"]),
    ("cc0", "to the extent possible under law released under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "gnu gpl"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license", "gnu library general public license"]),
    ("mit", "released under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
]
# Short names that also verify a notice, but only in the stretch where its words agree.
SHORT = {"agpl": ["agpl"], "apache-2.0": ["apache 2 0"], "gpl": ["gpl"], "lgpl": ["lgpl"], "mit": ["mit"], "mpl-2.0": ["mpl"]}
AGREE = 0.4  # share of a notice's words that agree at one beginning
VOTES = 3  # agreeing places of rare words that make a beginning worth comparing
SLACK = 4  # words around the stretch in which a mandatory phrase may stand
BARE = 0.25  # score of a mandatory phrase without its notice
VOCABULARY = sorted({w for _, notice, phrases in NOTICES for text in (notice, *phrases) for w in text.split()})


def _texts(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")  # one constant


def _phrase_at(words: Column, phrase: str, i: Column) -> Column:
    """Whether the phrase's words stand at ``i`` and after it."""
    found = F.lit(True)
    for k, w in enumerate(phrase.split()):
        found = found & F.coalesce(F.get(words, i + k) == w, F.lit(False))
    return found


def _any(flags: list[Column]) -> Column:
    return functools.reduce(operator.or_, flags)


def words_of(text: str = "text") -> Column:
    """Lower-cased words. Only A-Z fold: no other letter is turned into one that a phrase holds."""
    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.regexp_extract_all(F.translate(filled, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(LICENCE_WORD), F.lit(0))


def rarity(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every licence word over all documents; the driver gets one number for each word."""
    held = docs.select(F.array_intersect(_texts(VOCABULARY), words_of(text)).alias("held"))
    # the empty word counts the documents; the outer form infers no filter, which would work the words out again
    each = held.select(F.explode_outer(F.concat(F.array(F.lit("")), "held")).alias("word"))
    found = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + found.get("", 0)) / (1 + found.get(w, 0))) for w in VOCABULARY}


def rare_places(notice: str, idf: dict[str, float]) -> tuple[int, list[str]]:
    """(agreeing words needed, the notice with "-" at the places of its other words).

    Whatever agrees in ``need`` of n words agrees in at least VOTES of the n - need + VOTES rarest ones, so no beginning is lost.
    """
    words = notice.split()
    need = max(VOTES, math.ceil(AGREE * len(words)))
    rarest = set(sorted(range(len(words)), key=lambda k: (-idf[words[k]], words[k], k))[: len(words) - need + VOTES])
    return need, [w if k in rarest else "-" for k, w in enumerate(words)]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where a lambda reads it for each of its elements."""
    return F.get(F.transform(F.array(value), use), 0)


def scan_licenses(docs: DataFrame, idf: dict[str, float] | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base places, labels and score of each whole text.

    Everything is worked out inside a row, so no file meets another and nothing is shuffled but the word counts of ``rarity``.
    A null or empty text has no words, no places, labels "" and score 0. ``score`` is the highest share of agreeing words among
    the notices found, at least one half where a base phrase stands and BARE where only another mandatory phrase does; such a
    phrase gives its label too. Columns beyond ``keep`` are ignored, also such with names of the result; repeated rows give
    repeated results. Votes are counted over sorted places, so a text may hold any number of licence words.
    """
    idf = rarity(docs, text) if idf is None else idf
    ranked = sorted(VOCABULARY, key=lambda w: (-idf[w], w))  # array_intersect keeps this order
    marks = sorted({max(p.split(), key=lambda w: (idf[w], w)) for _, _, phrases in NOTICES for p in phrases})
    words = docs.select(*[F.col(c) for c in keep], words_of(text).alias("__words"))
    words = words.select(*keep, "__words", F.array_intersect(_texts(ranked), F.col("__words")).alias("__present"))
    suspect = F.arrays_overlap("__present", _texts(marks))
    phrased = F.arrays_overlap("__present", _texts(["license", "cc"]))
    none = F.array().cast("array<struct<at:int,label:string>>")

    def base(word: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            label = F.when(_phrase_at(F.col("__words"), phrase, i), name).otherwise(label)
        return F.struct(i.alias("at"), F.when(word.isin(sorted({p.split()[0] for p in BASE})), label).alias("label"))

    read = words.select(
        *keep, "__words", "__present", suspect.alias("__suspect"),
        F.when(phrased, F.filter(F.transform("__words", base), lambda s: s["label"].isNotNull())).otherwise(none).alias("__base"),
    )

    def agreeing(label: str, notice: str, phrases: list[str]) -> Column:
        """The highest share of words that agree at one beginning with a mandatory phrase in its stretch; null: none."""
        wanted, (need, rare) = notice.split(), rare_places(notice, idf)

        # for each word that the file holds its rare places in the notice; a hit tells its word by its number among those
        index = F.transform("__present", lambda x: F.filter(F.transform(_texts(rare), lambda w, k: F.when(w == x, k)), lambda k: k.isNotNull()))
        begins = _bound(index, lambda places: F.flatten(F.transform("__hits", lambda h: F.transform(F.get(places, h["word"]), lambda k: h["at"] - k))))

        def verified(begin: Column) -> Column:
            own = F.slice(_texts(wanted), F.greatest(F.lit(0), -begin) + 1, len(wanted))
            theirs = F.slice("__words", F.greatest(F.lit(0), begin) + 1, F.least(F.lit(0), begin) + len(wanted))
            agree = F.size(F.filter(F.zip_with(own, theirs, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))
            stretch = F.slice("__words", F.greatest(F.lit(0), begin - SLACK) + 1, len(wanted) + 2 * SLACK)
            named = _bound(F.concat(F.lit(" "), F.array_join(stretch, " "), F.lit(" ")), lambda said: _any([F.contains(said, F.lit(f" {p} ")) for p in (*phrases, *SHORT.get(label, ()))]))
            return _bound(agree, lambda n: F.when((n >= need) & named, n / len(wanted)))

        voted = _bound(
            F.sort_array(begins),
            lambda at: F.array_distinct(F.filter(at, lambda x, i: F.coalesce(F.get(at, i + (VOTES - 1)) == x, F.lit(False)))),
        )
        return F.array_max(F.transform(voted, verified))

    def enough(notice: str) -> Column:
        """Whether the file holds as many of the notice's words as have to agree."""
        held = F.size(F.filter(_texts(notice.split()), lambda w: F.array_contains("__present", w)))
        return held >= rare_places(notice, idf)[0]

    def stands(phrases: list[str]) -> Column:
        said = F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" "))
        return _bound(said, lambda whole: _any([F.contains(whole, F.lit(f" {p} ")) for p in phrases]))

    gates = read.withColumn("__open", F.array(*[enough(notice) for _, notice, _ in NOTICES]))
    hit = F.filter(F.transform("__words", lambda w, i: F.struct((F.array_position("__present", w) - 1).cast("int").alias("word"), i.alias("at"))), lambda h: h["word"] >= 0)
    opened = gates.withColumn("__hits", F.when(F.array_contains("__open", True), hit))
    verdicts = F.array(*[
        F.struct(F.lit(label).alias("label"), F.coalesce(
            F.when(F.get("__open", k), agreeing(label, notice, phrases)), F.when(F.col("__suspect") & stands(phrases), BARE),
        ).alias("share"))
        for k, (label, notice, phrases) in enumerate(NOTICES)
    ])
    asked = F.col("__suspect") | F.array_contains("__open", True)
    judged = opened.select(*keep, "__words", "__base", F.when(asked, F.filter(verdicts, lambda v: v["share"].isNotNull())).alias("__found"))
    labels = F.transform("__base", lambda s: s["label"])
    more = F.coalesce(F.transform("__found", lambda v: v["label"]), F.array().cast("array<string>"))
    share = F.coalesce(F.array_max(F.transform("__found", lambda v: v["share"])), F.lit(0.0))
    return judged.select(
        *keep, F.size("__words").cast("long").alias("n_words"), F.size("__base").cast("long").alias("n_base"),
        F.array_min(F.transform("__base", lambda s: s["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("__base", lambda s: s["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, more))), ",").alias("labels"),
        F.greatest(share, F.when(F.size("__base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
