"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a paragraph of a text: lines up to a blank one, so that a notice may be wrapped. A template
is a set of words. It is found where a run of a block's words, as long as the template is at the threshold
(its words / THRESHOLD), holds at least THRESHOLD of the set. Template words are ordered by how many blocks
of all documents hold them, rarest first. A run must hold the words that name the template's license (MARKS), if any; where templates of one
family differ in naming words alone (FAMILIES), a run ends before a name of another member. In a short template, of SHORT words at most, four words of
five are soon met by chance, so there they must stand in the template's order, and any other license's name ends a run. Long templates are found wherever the
threshold is met. A run that meets it must hold one of the first |T| - need + 1 words (prefix); the words around that place must hold at least `need` template words at
all (length and position); what is left is counted in full, run by run.

All of it is DataFrame functions. The templates are constants of this module, so what is
broadcast does not grow.

Null and empty texts have no words and no labels. Very long texts are cut into pieces of PIECE words for the join; a row's words are held at once. Labels belong to a doc_id and
its text, so rows of one id, or of none, are judged by their own texts. Repeated
blocks count once for labels; base places count each. Ties between containments have no say: all labels that meet the threshold stay. Only doc_id and
text are read, so other columns' names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[a-z0-9]+")
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
THRESHOLD = 0.8
#: Words of the pieces that long blocks are cut into; pieces overlap by the longest run.
PIECE = 512
#: (label, opening words of a public license or its usual notice).
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]
#: Templates that only differ from another in few words: a run must hold the words that tell them apart (MARKS).
CLOSE = [
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("bsd", "Released under the BSD License"),
    ("mpl", "Licensed under the Mozilla Public License, Version 2.0"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
]
#: Words that name a license. A run must hold those that its template holds.
MARKS = "gnu lesser affero apache mit bsd mozilla cc creative nc sa nd noncommercial sharealike noderivatives noderivs commercial alike derivatives derivs unencumbered".split()
#: Names that tell the members of a family apart, and those that tell short notices apart.
FAMILIES = [set("gnu lesser affero".split()), set("cc creative nc sa nd noncommercial sharealike noderivatives noderivs commercial alike derivatives derivs".split())]
NAMES = set("gnu apache mit bsd mozilla cc creative".split())
#: Distinct words of a short template.
SHORT = 8


def normal(text: Column) -> Column:
    """Words of a text in lower case, separated by single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " "))


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _word_count(spaced: Column) -> Column:
    """Words of a string that single spaces separate, with or without spaces at its ends."""
    bare = F.trim(spaced)
    return F.when(bare == "", F.lit(0)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, and the places of the base phrases: a text is cut before each place, so
    the words of the first piece come before the first place, those of the last begin at the last."""
    words = docs.select("doc_id", text_key(), F.concat(F.lit(" "), normal(F.col("text")), F.lit(" ")).alias("spaced"))
    cut = " (?=" + "|".join(f"{p} " for p in PHRASES) + ")"
    found = {label: F.contains("spaced", F.lit(f" {p} ")) for p, label in PHRASES.items()}
    some = F.greatest(*found.values())
    pieces = words.select(
        "doc_id", "text_key", _word_count(F.col("spaced")).alias("n_words"),
        F.when(some, F.split("spaced", cut)).alias("pieces"),
        F.array_compact(F.array(*(F.when(c, F.lit(label)) for label, c in sorted(found.items())))).alias("base"),
    )
    return pieces.select(
        "doc_id", "text_key", "n_words", "base",
        F.coalesce(F.size("pieces") - 1, F.lit(0)).cast("long").alias("n_base"),
        _word_count(F.element_at("pieces", 1)).alias("first_word"),
        (F.col("n_words") - _word_count(F.element_at("pieces", -1))).alias("last_word"),
    ).withColumn("n_base", F.when(F.size("base") > 0, F.col("n_base")).otherwise(F.lit(0)).cast("long"))


def _template_words(text: str) -> list[str]:
    return sorted(set(WORD.findall(text.lower())))


def rules(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    """What the join knows of each template: its words as a set and in their order, how many are needed in a run of how many words,
    names that must be there, names that end a run, and terms that must stand together."""
    out = []
    for label, text in templates:
        words = WORD.findall(text.lower())
        t = set(words)
        own = [m for m in MARKS if m in t]
        ends = set().union(*(f for f in FAMILIES if f & set(own)), NAMES if len(t) <= SHORT and NAMES & set(own) else set()) - t
        terms = f" {' '.join(label.split('-')[1:])} " if "cc" in t else ""  # by, nc, sa and nd stand together
        out.append({"label": label, "set": sorted(t), "order": list(dict.fromkeys(words)) if len(t) <= SHORT else [], "need": math.ceil(threshold * len(t) - 1e-9), "run": math.ceil(len(words) / threshold - 1e-9), "own": own, "ends": sorted(ends), "terms": terms})
    return out


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, block): the lines of all texts, as words."""
    found = docs.select("doc_id", text_key(), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block"))
    return found.select("doc_id", "text_key", normal(F.col("block")).alias("block"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, block): the lines of all texts up to a blank one, as words."""
    found = docs.select("doc_id", text_key(), F.explode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t\r\f\x0B]*\n")).alias("block"))
    return found.select("doc_id", "text_key", normal(F.col("block")).alias("block"))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, blocks: Callable[[DataFrame], DataFrame] = lines) -> DataFrame:
    """(doc_id, text_key, label, containment) for every template and the runs of blocks that meet the threshold and its rules."""
    spark = docs.sparkSession
    known_rules = rules(templates, threshold)
    vocabulary = sorted({w for r in known_rules for w in r["set"]})
    split = blocks(docs).select("doc_id", "text_key", F.split("block", " ").alias("words"))
    known = split.select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("word"))
    frequency = {r["word"]: r["n"] for r in known.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most one row a template word
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    rows = []
    for r in known_rules:
        t = sorted(r["set"], key=rank.get)
        rows += [(w, r["label"], t, r["order"], r["need"], r["run"], r["own"], r["ends"], r["terms"]) for w in t[: len(t) - r["need"] + 1]]
    prefix = spark.createDataFrame(rows, "word string, label string, t_words array<string>, t_order array<string>, need int, run int, own array<string>, ends array<string>, terms string")
    rare, longest = _literal(sorted({r[0] for r in rows})), max(r["run"] for r in known_rules)
    held = split.where(F.arrays_overlap("words", rare))
    starts = F.sequence(F.lit(1), F.size("words"), F.lit(PIECE))
    pieces = held.select("doc_id", "text_key", "words", F.explode(starts).alias("start")).select("doc_id", "text_key", F.slice("words", F.col("start"), F.lit(PIECE + longest)).alias("words")).where(F.arrays_overlap("words", rare))
    near = lambda p: F.slice("words", F.greatest(p - longest + 1, F.lit(1)), F.least(p, F.lit(longest)) + longest - 1)
    places = F.filter(F.sequence(F.lit(1), F.size("words")), lambda p: F.array_contains(rare, F.get("words", p - 1)))
    around = F.transform(places, lambda p: F.struct(F.get("words", p - 1).alias("word"), F.least(p, F.lit(longest)).alias("at"), near(p).alias("near")))
    pairs = pieces.select("doc_id", "text_key", F.inline(around)).join(F.broadcast(prefix), "word")
    first = F.greatest(F.col("at") - F.col("run") + 1, F.lit(1))
    pairs = pairs.withColumn("near", F.slice("near", first, F.col("at") + F.col("run") - first))
    shared = lambda words: F.size(F.array_intersect("t_words", words))
    pairs = pairs.where(shared(F.col("near")) >= F.col("need"))
    # A name that ends a run: with "" in its place, runs from all starts are cut before it.
    pairs = pairs.withColumn("near", F.transform("near", lambda w: F.when(F.array_contains(F.col("ends"), w), F.lit("")).otherwise(w)))
    run = lambda i: F.slice("near", i, F.least(F.coalesce(F.nullif(F.array_position(F.slice("near", i, F.col("run")), F.lit("")), F.lit(0)) - 1, F.col("run")), F.col("run")).cast("int"))
    named = lambda words: (F.size(F.array_intersect("own", words)) == F.size("own")) & F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.col("terms"))
    stand = lambda words: F.filter(F.transform("t_order", lambda w: F.array_position(words, w)), lambda p: p > 0)
    in_order = lambda words: (F.size("t_order") == 0) | (stand(words) == F.array_sort(stand(words)))
    found = F.transform(F.sequence(F.lit(1), F.size("near")), lambda i: F.when(named(run(i)) & in_order(run(i)), shared(run(i))).otherwise(F.lit(0)))
    best = pairs.withColumn("best", F.array_max(found))
    return best.where("best >= need").select("doc_id", "text_key", "label", (F.col("best") / F.size("t_words")).alias("containment")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document.

    score is 1 where a base phrase stands, else the largest containment found, else 0.
    """
    tune(docs.sparkSession)
    added = template_matches(docs, [*TEMPLATES, *CLOSE], blocks=paragraphs).groupBy(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).agg(F.collect_set("label").alias("added"), F.max("containment").alias("best"))
    joined = base(docs).join(added, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
